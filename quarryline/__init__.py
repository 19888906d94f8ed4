"""quarryline: DataFrame operators for software-build outcomes and text evidence."""
