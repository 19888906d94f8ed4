"""One form for texts that look the same, and the pairs of documents that do.

Each text is decomposed, wide and narrow forms and ligatures are resolved, kinds of blank and of
hyphen become one, mathematical fonts and Roman numerals their letters, invisible characters go. Then every
token of letters is resolved by scripts: each letter stands for a shape and a shape has the set of scripts that
can write it (any script that Unicode names; only letters of ``LOOKALIKES`` and ``SHARED`` have more than their own);
the sets are intersected over the token. If Latin can write the whole token it is spelled in Latin (mixed-script and
whole-script look-alikes alike), else in the first other script that can; a token that
no single script can write is spelled shape by shape, Latin where possible. The choice depends on the
shapes alone, so two texts get the same form exactly if they look the same.

Texts of ASCII characters only are their own form and never reach Python.

Classes: documents are grouped by two 64-bit hashes of the form. The hashes (32 bytes a document) are
checkpointed, so that every text is normalised once. Classes with a single text are dropped by a
combinable aggregate before anything is paired. ``lookalike_members_of`` gives one row per document with its class and
its number of links; pairs are made from it only where they are asked for: between the distinct texts of a
class, then between slices of their documents of about ``SLICE`` ids, spread evenly, so that neither copies
are paired with each other nor a hot class meets in one task.

Defined cases: null, empty and invisible-only texts have a form (null, "", "") but no pair; case,
digits, punctuation, accents and the numbers of blanks and line breaks are kept; a null id forms
no pair; repeated rows of an id form no pair with themselves.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import ensure_checkpoint_dir

#: Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "Cyrillic": {"а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
                 "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y"},
    "Greek": {"α": "a", "ι": "i", "ϳ": "j", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ϲ": "c", "γ": "y",
              "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z"},
    "Armenian": {"ց": "g", "հ": "h", "ո": "n", "օ": "o", "ս": "u", "զ": "q", "Լ": "L", "Տ": "S", "Օ": "O", "Ս": "U"},
    "Cherokee": {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z"},
    "Coptic": {"Ⲁ": "A", "Ⲃ": "B", "Ⲥ": "C", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲧ": "T", "Ⲭ": "X", "Ⲩ": "Y", "Ⲍ": "Z", "ⲥ": "c", "ⲓ": "i", "ⲟ": "o", "ⲣ": "p", "ⲭ": "x"},
    "Lisu": {"ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z"},
    "Latin": {"ɡ": "g", "ɑ": "a", "ı": "i", "ſ": "f", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z"},
}
#: Greek letters that look like a Cyrillic one and like no Latin one.
SHARED = {"κ": "к", "τ": "т", "π": "п", "φ": "ф", "Γ": "Г", "Π": "П", "Φ": "Ф"}
#: Characters that show as a hyphen, and invisible ones outside category Cf.
HYPHENS = "‐‑﹣－"
#: Ranges of ligatures, digraphs and Roman numerals that show as the letters they are made of.
JOINED = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xB5, 0xB5), (0xFB00, 0xFB4F))
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
#: Scripts in which a token is spelled, first that can; others follow by name.
ORDER = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")


@cache
def _tables() -> tuple[dict[int, str | None], dict[int, str], dict[str, int], dict[str, dict[int, str]]]:
    """Per character: its plain form; its shape; per shape: scripts as bits; per script: the spelling of shapes."""
    plain: dict[int, str | None] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F or ch in INVISIBLE:
            plain[cp] = None
        elif kind == "Zs":
            plain[cp] = " "
        elif ch in HYPHENS:
            plain[cp] = "-"
        elif cp in (0x85, 0x2028, 0x2029):
            plain[cp] = "\n"
        elif (form := unicodedata.decomposition(ch)).startswith(("<wide>", "<narrow>", "<font>")) or (form.startswith("<compat>") and any(a <= cp <= b for a, b in JOINED)):
            plain[cp] = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch))
    shape = {ord(a): b for pairs in (*LOOKALIKES.values(), SHARED) for a, b in pairs.items()}
    scripts: dict[str, int] = {}
    spelling: dict[str, dict[int, str]] = {}
    for script, pairs in LOOKALIKES.items():
        for a, b in pairs.items():
            scripts[b] = scripts.get(b, _bit("LATIN")) | _bit(script.upper())
            if script != "Latin":
                spelling.setdefault(script.upper(), {}).setdefault(ord(b), a)
    for a, b in SHARED.items():
        scripts[b] = _bit("CYRILLIC") | _bit("GREEK")
        spelling["GREEK"][ord(b)] = a
    return plain, shape, scripts, spelling


_BITS: dict[str, int] = {}


def _bit(script: str) -> int:
    return _BITS.setdefault(script, 1 << len(_BITS))


@cache
def _own_script(ch: str) -> int:
    """The script of a letter: the first word of its name; letters without a name are of no script."""
    name = unicodedata.name(ch, "")
    return _bit(name.split(" ", 1)[0].split("-", 1)[0]) if name else 0


#: Documents of one text that are paired at once.
SLICE = 1000
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
#: Characters that may need a plain form: all but ASCII, accents, and the common blocks that never do.
_SPECIAL = re.compile(r"[^\x00-\x7f\u00c0-\u0131\u0134-\u01c3\u01cd-\u01f0\u01f4-\u024f\u0300-\u034e\u0350-\u036f\u0391-\u03c9\u0400-\u045f\u3041-\u30ff\u4e00-\u9fff]")
#: Letters that other scripts share with Latin, or that decide a script.
_OTHER_SCRIPTS = re.compile(r"[\u0131\u017f\u0250-\u02af\u0370-\u058f\u13a0-\u13ff\u1d00-\u1d7f\u1f00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff\ua731]")


def _plain(m: re.Match[str]) -> str:
    ch = m[0]
    form = _tables()[0].get(ord(ch), ch)
    return "" if form is None else form


def _resolve(token: re.Match[str]) -> str:
    word = token[0]
    if word.isascii():
        return word
    _, shape, scripts, spelling = _tables()
    shapes = word.translate(shape)
    able = -1
    for ch in shapes:
        if not "̀" <= ch <= "ͯ":
            able &= scripts.get(ch) or _own_script(ch)
    if able & _bit("LATIN") or not able:
        return shapes
    script = next((s for s in ORDER if able & _bit(s)), "")
    return shapes.translate(spelling.get(script, {}))


def normal_form(text: str | None) -> str | None:
    """The one form of ``text``, composed (NFC)."""
    if text is None or text.isascii():
        return text
    if unicodedata.is_normalized("NFC", text) and not _SPECIAL.search(text) and not _OTHER_SCRIPTS.search(text):
        return text
    plain = _SPECIAL.sub(_plain, unicodedata.normalize("NFD", text))
    if _OTHER_SCRIPTS.search(plain):
        plain = _TOKEN.sub(_resolve, plain)
    return unicodedata.normalize("NFC", plain)


def with_normal_form(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, normal."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(normal_form, na_action="ignore")

    text = F.col("text")
    beyond_ascii = text.rlike(r"[^\x00-\x7F]")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.withColumn("normal", F.coalesce(form(F.when(beyond_ascii, text)), text))


def lookalike_members(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, form_a, form_b (hashes of the form), text_hash of every document with something visible."""
    formed = with_normal_form(docs, id_column, text_column).filter(F.col("doc_id").isNotNull() & F.col("normal").rlike(r"[^\s\x00-\x1F\x7F]"))
    return formed.select("doc_id", F.xxhash64("normal").alias("form_a"), F.xxhash64(F.lit("form"), "normal").alias("form_b"), F.xxhash64("text").alias("text_hash"))


def lookalike_classes(members: DataFrame) -> DataFrame:
    """The members of classes that hold more than one text."""
    key = ["form_a", "form_b"]
    mixed = members.groupBy(*key).agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).filter("lo <> hi").select(*key)
    return members.join(mixed, key, "left_semi")


def lookalike_members_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """class_id, doc_id, text_id, n_links: one row per document that looks like another text.

    ``class_id`` and ``text_id`` are the least doc_id of the class and of the byte-identical copies; ``n_links`` is the number of documents of
    the class with another text. All by combinable aggregates, no pair is made."""
    ensure_checkpoint_dir(docs.sparkSession)
    members = lookalike_classes(lookalike_members(docs, id_column, text_column).checkpoint()).distinct()
    key = ["form_a", "form_b"]
    texts = members.groupBy(*key, "text_hash").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"))
    classes = texts.groupBy(*key).agg(F.min("text_id").alias("class_id"), F.sum("n_copies").alias("n_members"))
    rows = members.join(texts, [*key, "text_hash"]).join(classes, key)
    return rows.select("class_id", "doc_id", "text_id", (F.col("n_members") - F.col("n_copies")).alias("n_links"))


def lookalike_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slice_size: int = SLICE) -> DataFrame:
    """doc_id_a < doc_id_b for documents whose texts differ but look the same."""
    key = ["form_a", "form_b"]
    ensure_checkpoint_dir(docs.sparkSession)
    members = lookalike_classes(lookalike_members(docs, id_column, text_column).checkpoint()).distinct()
    texts = members.groupBy(*key, "text_hash").agg(F.ceil(F.count("*") / slice_size).alias("n_slices"))
    sliced = members.join(texts, [*key, "text_hash"]).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("n_slices")))
    slices = sliced.groupBy(*key, "text_hash", "slice").agg(F.collect_list("doc_id").alias("ids"))  # about slice_size ids each
    sides = [slices.select(*key, *[F.col(c).alias(f"{c}_{x}") for c in ("text_hash", "slice", "ids")]) for x in "ab"]
    keys = [s.drop(f"ids_{x}") for s, x in zip(sides, "ab", strict=True)]
    pairs = keys[0].join(keys[1], key).filter("text_hash_a < text_hash_b")
    joined = pairs.join(sides[0], [*key, "text_hash_a", "slice_a"]).join(sides[1], [*key, "text_hash_b", "slice_b"])
    # Each row stands for up to the square of a slice; rows of one class are spread over all tasks.
    spread = joined.repartition(F.xxhash64(*key, "text_hash_a", "slice_a", "text_hash_b", "slice_b"))
    found = spread.select(F.explode("ids_a").alias("a"), "ids_b").select("a", F.explode("ids_b").alias("b")).filter("a <> b")
    return found.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
