"""Nested commit records to flat tables that keep parent-child links.

Two collectors wrote the records. The newer one fills the typed array ``commits``; the older one
left JSON text in ``commits_json`` in which a one-element list may be a bare value, lists have
other names, a step is text or an object, ids are text and keys may be missing, null or unknown.

A bottom-up tree automaton gives every node a state. ``STEP_MOVES``, ``JOIN_MOVES``, ``JOB_MOVES`` and
``COMMIT_MOVES`` are its transitions: a node's symbols are what is seen of it alone (kind, list name, container),
the states of its children are joined one by one, and symbols and joined state lead to the node's state. A
node without a transition has no state. The state names the structural variant and ``ROUTES`` sends it to a
typed subtype table; all of them keep the supertype's keys (record_id, positions), so a child finds its parent
whichever collector wrote it. ``nodes`` is the union of these tables, read in one pass.

Everything is JVM expressions over VARIANT and arrays: one scan, one generate, no shuffle. Text that VARIANT
refuses (a repeated key, more than its size limit) is read level by level with ``from_json``; of a repeated key
the last value counts there, and a text that is itself a JSON list or object is read as one.

Defined cases: a null or empty list has no rows; a null element, a null or blank step and an object without
a name are no rows but keep their positions; a bare value is at position 0; text that is not JSON has the record
state ``unparsable`` and is in ``rejects``; a key that is absent or null gives way to its older name; null
``record_id`` is kept as null; other columns of the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrays import let

#: Names of the two lists, newest first.
JOB_LISTS = ("failed_validation_jobs", "failed_jobs")
STEP_LISTS = ("failed_validation_step_names", "step_names")

JOB_FIELDS = {"job_id": "bigint", "job_name": "string", "runner_name": "string", "failure_evidence": "string", "failed_validation_steps_count": "int"}
#: All validation jobs of a commit, failed or not, under their names.
ALL_JOB_LISTS = ("validation_jobs", "overall_jobs")
ALL_STEP_LISTS = ("validation_step_names", "step_names")
ALL_JOB_FIELDS = {"job_id": "bigint", "job_name": "string", "status": "string", "conclusion": "string", "started_at": "string", "completed_at": "string"}
COMMIT_FIELDS = {"original_commit": "string", "commit_type": "string", "commit_date": "string", "workflow_run_id": "bigint", "workflow_conclusion": "string", "pending": "boolean"}

#: Spellings of dates, tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "dd/MM/yyyy HH:mm:ss", "yyyyMMdd'T'HHmmssXXX", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd",
)


def parse_date(text: Column) -> Column:
    """A timestamp from any of the spellings in ``DATE_FORMATS``, epoch seconds included; else null."""
    tries = [F.try_to_timestamp(F.trim(text), F.lit(x)) for x in DATE_FORMATS]
    epoch = F.when(F.trim(text).rlike(r"^\d{9,10}\z"), F.timestamp_seconds(F.trim(text).try_cast("bigint")))
    return F.coalesce(*tries, epoch)


#: Transitions of a step by its symbol. "null" and "blank" have none.
STEP_MOVES = {"text": "text", "object": "object", "other": "other"}
#: States of a list of children, one child after the other: (state so far, next child) to state.
JOIN_MOVES = {
    ("none", "none"): "none", ("none", "text"): "text", ("none", "object"): "object", ("none", "other"): "other", ("none", "mixed"): "mixed",
    ("text", "none"): "text", ("text", "text"): "text", ("text", "object"): "mixed", ("text", "other"): "mixed", ("text", "mixed"): "mixed",
    ("object", "none"): "object", ("object", "text"): "mixed", ("object", "object"): "object", ("object", "other"): "mixed", ("object", "mixed"): "mixed",
    ("other", "none"): "other", ("other", "text"): "mixed", ("other", "object"): "mixed", ("other", "other"): "other", ("other", "mixed"): "mixed",
    ("mixed", "none"): "mixed", ("mixed", "text"): "mixed", ("mixed", "object"): "mixed", ("mixed", "other"): "mixed", ("mixed", "mixed"): "mixed",
}
_CHILDREN = ("none", "text", "object", "other", "mixed")


def _list_moves(newer: str, older: str) -> dict[tuple[str, str, str], str]:
    """Transitions of a node with a list of children: (name of the list, container, joined children) to state."""
    moves = {("none", "absent", "none"): "none/absent/none", ("typed", "absent", "none"): "typed/absent/none"}
    for children in _CHILDREN:
        moves["typed", "list", children] = f"typed/list/{children}"
        for name in (newer, older):
            for container in ("list", "bare"):
                moves[name, container, children] = f"{name}/{container}/{children}"
    return moves


JOB_MOVES = _list_moves(*STEP_LISTS)
COMMIT_MOVES = _list_moves(*JOB_LISTS)
#: The subtype table of a state, by the state's first part.
ROUTES = {
    "step": {"text": "step_text", "object": "step_object", "other": "step_other"},
    "job": {"typed": "job_typed", STEP_LISTS[0]: "job_newer", STEP_LISTS[1]: "job_older", "none": "job_without_steps"},
    "commit": {"typed": "commit_typed", JOB_LISTS[0]: "commit_newer", JOB_LISTS[1]: "commit_older", "none": "commit_without_jobs"},
}


def _move(moves: Mapping, *symbols: Column) -> Column:
    """The transition from ``symbols``, null where there is none."""
    flat = {k if isinstance(k, str) else "|".join(k): v for k, v in moves.items()}
    if not flat:
        return F.lit(None).cast("string")
    key = symbols[0] if len(symbols) == 1 else F.concat_ws("|", *symbols)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in flat.items() for x in pair]), key)


def _joined(states: Column) -> Column:
    """The children's states joined from left to right; repeats change nothing, and a child without a state is passed over."""
    return F.aggregate(F.array_distinct(F.filter(states, lambda s: s.isNotNull())), F.lit("none"), lambda so_far, s: _move(JOIN_MOVES, so_far, s))


def _route(node: str, state: Column) -> Column:
    return _move(ROUTES[node], F.substring_index(state, "/", 1))


def _filled(text: Column) -> Column:
    """The text, null where there is nothing but white space in it."""
    return F.when(F.regexp_replace(text, r"\s+", "") != "", text)


class _Variant:
    """A value of a document parsed as VARIANT."""

    @staticmethod
    def present(v: Column) -> Column:
        """``v``, or SQL null where it is JSON's null."""
        return F.when(~F.is_variant_null(v), v)

    @staticmethod
    def opened(v: Column, _: Mapping[str, str], __: tuple[str, ...], body: Callable[[Column], Column]) -> Column:
        return body(v)

    @staticmethod
    def field(v: Column, name: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", kind)

    @staticmethod
    def inner(v: Column, name: str) -> Column:
        return _Variant.present(F.try_variant_get(v, f"$.{name}", "variant"))

    @staticmethod
    def elements(v: Column) -> Column:
        return F.try_variant_get(v, "$", "array<variant>")

    @staticmethod
    def text(s: Column) -> Column:
        return F.when(F.schema_of_variant(s).startswith("OBJECT"), F.try_variant_get(s, "$.name", "string")).otherwise(F.try_variant_get(_Variant.present(s), "$", "string"))

    @staticmethod
    def step(s: Column) -> Column:
        kind = F.schema_of_variant(s)
        is_object = kind.startswith("OBJECT")
        text = _filled(F.when(is_object, F.try_variant_get(s, "$.name", "string")).otherwise(F.try_variant_get(s, "$", "string")))
        symbol = F.when(s.isNull() | F.is_variant_null(s), "null").when(text.isNull(), "blank").when(is_object, "object").when(kind == "STRING", "text").otherwise("other")
        return _step(text, F.when(is_object, F.try_variant_get(s, "$.number", "int")), symbol)


class _Text:
    """A value of a document that stays JSON text: each level is read when it is opened."""

    @staticmethod
    def present(v: Column) -> Column:
        return v

    @staticmethod
    def opened(v: Column, fields: Mapping[str, str], lists: tuple[str, ...], body: Callable[[Column], Column]) -> Column:
        return let(F.from_json(v, ", ".join(f"{n} string" for n in (*fields, *lists))), body)

    @staticmethod
    def field(r: Column, name: str, kind: str) -> Column:
        return r[name].try_cast(kind)

    @staticmethod
    def inner(r: Column, name: str) -> Column:
        return r[name]

    @staticmethod
    def elements(v: Column) -> Column:
        return F.from_json(v, "array<string>")

    @staticmethod
    def step(s: Column) -> Column:
        is_object = s.startswith("{") & F.from_json(s, "map<string,string>").isNotNull()
        opened = F.from_json(F.when(is_object, s), "name string, number string")
        text = _filled(F.when(is_object, opened["name"]).otherwise(s))
        return _step(text, opened["number"].try_cast("int"), F.when(s.isNull(), "null").when(text.isNull(), "blank").when(is_object, "object").otherwise("text"))


    @staticmethod
    def text(s: Column) -> Column:
        is_object = s.startswith("{") & F.from_json(s, "map<string,string>").isNotNull()
        return F.when(is_object, F.from_json(F.when(is_object, s), "name string")["name"]).otherwise(s)


_Reader = type[_Variant] | type[_Text]


def _step(text: Column, number: Column, symbol: Column) -> Column:
    return F.struct(text.alias("step_name"), number.alias("step_number"), _move(STEP_MOVES, symbol).alias("state"))


def _step_from_text(s: Column) -> Column:
    text = _filled(s)
    return _step(text, F.lit(None).cast("int"), F.when(s.isNull(), "null").when(text.isNull(), "blank").otherwise("text"))


def _node(fields: list[Column], children: Column, name: str, moves: Mapping, alias: Column, container: Column, child_state: Callable[[Column], Column]) -> Column:
    """A node with its list of children, read once, and its state."""

    def of(c: Column) -> Column:
        # The children are joined by what their own children are.
        state = _move(moves, alias, container, F.coalesce(_joined(F.transform(c, child_state)), F.lit("none")))
        return F.struct(*fields, c.alias(name), state.alias("state"))

    return let(children, of)


def _own_state(step: Column) -> Column:
    return step["state"]


def _children_state(job: Column) -> Column:
    return F.substring_index(job["state"], "/", -1)


def _from_list(r: _Reader, v: Column, lists: tuple[str, ...], body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of the elements of the first of ``lists`` that ``v`` has, its name and its container."""
    alias = F.when(F.lit(False), "")
    for n in lists:
        alias = alias.when(r.inner(v, n).isNotNull(), n)
    found = F.coalesce(*[r.inner(v, n) for n in lists])

    def split(x: Column) -> Column:
        as_list = lambda e: body(F.coalesce(e, F.when(x.isNotNull(), F.array(x))), alias.otherwise("none"), F.when(x.isNull(), "absent").when(e.isNotNull(), "list").otherwise("bare"))
        return let(r.elements(x), as_list)

    return let(found, split)


def _job_of(r: _Reader) -> Callable[[Column], Column]:
    def job(j: Column) -> Column:
        def of(o: Column) -> Column:
            fields = [r.field(o, n, t).alias(n) for n, t in JOB_FIELDS.items()]
            return _from_list(r, o, STEP_LISTS, lambda e, alias, box: _node(fields, F.transform(e, r.step), "steps", JOB_MOVES, alias, box, _own_state))

        return F.when(r.present(j).isNotNull(), r.opened(j, JOB_FIELDS, STEP_LISTS, of))

    return job


def _commit_of(r: _Reader) -> Callable[[Column], Column]:
    def commit(c: Column) -> Column:
        def of(o: Column) -> Column:
            fields = [r.field(o, n, t).alias(n) for n, t in COMMIT_FIELDS.items()]
            return _from_list(r, o, JOB_LISTS, lambda e, alias, box: _node(fields, F.transform(e, _job_of(r)), "jobs", COMMIT_MOVES, alias, box, _children_state))

        return F.when(r.present(c).isNotNull(), r.opened(c, COMMIT_FIELDS, JOB_LISTS, of))

    return commit


def _typed_job(j: Column) -> Column:
    steps = j["failed_validation_step_names"]
    fields = [j[n].cast(t).alias(n) for n, t in JOB_FIELDS.items()]
    return F.when(j.isNotNull(), _node(fields, F.transform(steps, _step_from_text), "steps", JOB_MOVES, F.lit("typed"), F.when(steps.isNull(), "absent").otherwise("list"), _own_state))


def _typed_commit(c: Column) -> Column:
    jobs = c["failed_validation_jobs"]
    fields = [c[n].cast(t).alias(n) for n, t in COMMIT_FIELDS.items()]
    return F.when(c.isNotNull(), _node(fields, F.transform(jobs, _typed_job), "jobs", COMMIT_MOVES, F.lit("typed"), F.when(jobs.isNull(), "absent").otherwise("list"), _children_state))


def _fields_of(r: _Reader) -> Callable[[Column], Column]:
    """A commit of a document without its jobs."""
    of = lambda o: F.struct(*[r.field(o, n, t).alias(n) for n, t in COMMIT_FIELDS.items()])
    return lambda c: F.when(r.present(c).isNotNull(), r.opened(c, COMMIT_FIELDS, (), of))


def _typed_fields(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(*[c[n].cast(t).alias(n) for n, t in COMMIT_FIELDS.items()]))


def _run_of(r: _Reader) -> Callable[[Column], Column]:
    """A commit of a document with all its validation jobs."""

    def job(j: Column) -> Column:
        def of(o: Column) -> Column:
            fields = [r.field(o, n, t).alias(n) for n, t in ALL_JOB_FIELDS.items()]
            return _from_list(r, o, ALL_STEP_LISTS, lambda e, *_: F.struct(*fields, F.transform(e, r.text).alias("steps")))

        return F.when(r.present(j).isNotNull(), r.opened(j, ALL_JOB_FIELDS, ALL_STEP_LISTS, of))

    def commit(c: Column) -> Column:
        def of(o: Column) -> Column:
            fields = [r.field(o, n, t).alias(n) for n, t in COMMIT_FIELDS.items()]
            return _from_list(r, o, ALL_JOB_LISTS, lambda e, *_: F.struct(*fields, F.transform(e, job).alias("jobs")))

        return F.when(r.present(c).isNotNull(), r.opened(c, COMMIT_FIELDS, ALL_JOB_LISTS, of))

    return commit


def _typed_run(c: Column) -> Column:
    job = lambda j: F.when(j.isNotNull(), F.struct(*[j[n].cast(t).alias(n) for n, t in ALL_JOB_FIELDS.items()], j["validation_step_names"].alias("steps")))
    return F.when(c.isNotNull(), F.struct(*[c[n].cast(t).alias(n) for n, t in COMMIT_FIELDS.items()], F.transform(c["validation_jobs"], job).alias("jobs")))


@dataclass(frozen=True)
class NestedTables:
    """The flat tables of one input. All are lazy and read the input once each."""

    normal: DataFrame

    def _commits(self) -> DataFrame:
        return self.normal.select("record_id", "id", F.posexplode("commits").alias("commit_pos", "c")).filter("c.state is not null")

    def _jobs(self) -> DataFrame:
        return self._commits().select("record_id", "commit_pos", F.posexplode("c.jobs").alias("job_pos", "j")).filter("j.state is not null")

    def records(self) -> DataFrame:
        """One row per record with its automaton state."""
        return self.normal.select("record_id", "id", "record_state")

    def rejects(self) -> DataFrame:
        """Records that no reader takes, with the reason and the text."""
        return self.normal.filter("record_state = 'unparsable'").select("record_id", "id", F.col("record_state").alias("reason"), "commits_json")

    def commits(self) -> DataFrame:
        """Supertype table of commits, linked to their record."""
        return self._commits().select("record_id", "commit_pos", "id", *[F.col(f"c.{n}").alias(n) for n in COMMIT_FIELDS], parse_date(F.col("c.commit_date")).alias("committed_at"), F.col("c.state").alias("variant"))

    def jobs(self) -> DataFrame:
        """Supertype table of failed jobs, linked to their commit."""
        return self._jobs().select("record_id", "commit_pos", "job_pos", *[F.col(f"j.{n}").alias(n) for n in JOB_FIELDS], F.col("j.state").alias("variant"))

    def steps(self) -> DataFrame:
        """Supertype table of failed steps, linked to their job."""
        return (
            self._jobs()
            .select("record_id", "commit_pos", "job_pos", F.posexplode("j.steps").alias("step_pos", "s"))
            .filter("s.state is not null")
            .select("record_id", "commit_pos", "job_pos", "step_pos", F.col("s.step_name").alias("step_name"), F.col("s.step_number").alias("step_number"), F.col("s.state").alias("variant"))
        )

    def subtypes(self) -> dict[str, DataFrame]:
        """The typed table of each variant, by the names of ``ROUTES``: the keys and the columns that the variant can fill."""
        of = {"commit": self.commits(), "job": self.jobs(), "step": self.steps()}
        out = {t: of[node].filter(_route(node, F.col("variant")) == t) for node, routes in ROUTES.items() for t in routes.values()}
        return {t: rows if t == "step_object" else rows.drop("step_number") for t, rows in out.items()}

    def nodes(self) -> DataFrame:
        """Keys of all rows of the subtype tables, in one pass: record_id, node, commit_pos, job_pos, step_pos."""

        def key(node: str, state: Column, *pos: Column) -> Column:
            at = [*pos, *[F.lit(-1)] * (3 - len(pos))]
            row = F.struct(F.lit(node).alias("node"), *[p.cast("int").alias(n) for p, n in zip(at, ("commit_pos", "job_pos", "step_pos"), strict=True)])
            return F.when(_route(node, state).isNotNull(), row)

        def of_job(ci: Column):
            def one(j: Column, ji: Column) -> Column:
                steps = F.transform(j["steps"], lambda s, si: key("step", s["state"], ci, ji, si))
                return F.when(j["state"].isNotNull(), F.concat(F.array(key("job", j["state"], ci, ji)), F.coalesce(steps, F.array()))).otherwise(F.array())

            return one

        def of_commit(c: Column, ci: Column) -> Column:
            jobs = F.flatten(F.transform(c["jobs"], of_job(ci)))
            return F.when(c["state"].isNotNull(), F.concat(F.array(key("commit", c["state"], ci)), F.coalesce(jobs, F.array()))).otherwise(F.array())

        return self.normal.select("record_id", F.explode(F.flatten(F.transform("commits", of_commit))).alias("k")).filter("k is not null").select("record_id", "k.*")


def _read(df: DataFrame, *columns: str, typed: Callable[[Column], Column], document: Callable[[_Reader], Callable[[Column], Column]]) -> DataFrame:
    """``columns``, record_state and commits of both collectors in one shape."""
    is_typed, text, parsed = F.col("commits").isNotNull(), F.col("legacy"), F.col("parsed")
    base = df.select(*columns, "commits", F.when(~is_typed, F.col("commits_json")).alias("legacy")).withColumn("parsed", F.try_parse_json("legacy"))
    doc = _Variant.present(parsed)
    refused = text.isNotNull() & parsed.isNull()
    by_text = F.when(refused, _Text.elements(text))
    bare_text = F.when(refused & by_text.isNull() & F.from_json(F.when(refused, text), "map<string,string>").isNotNull(), text)
    listed = _Variant.elements(doc)
    commits = (
        F.when(is_typed, F.transform("commits", typed))
        .when(doc.isNotNull(), F.transform(F.coalesce(listed, F.array(doc)), document(_Variant)))
        .otherwise(F.transform(F.coalesce(by_text, F.when(bare_text.isNotNull(), F.array(bare_text))), document(_Text)))
    )
    state = (
        F.when(is_typed, "typed/list").when(text.isNull(), "none/absent").when(listed.isNotNull() | by_text.isNotNull(), "json/list")
        .when(doc.isNotNull() | bare_text.isNotNull(), "json/bare").when(refused, "unparsable").otherwise("json/absent")
    )
    return base.select(*columns, state.alias("record_state"), commits.alias("commits"))


def flatten_commits(df: DataFrame) -> NestedTables:
    """Flat tables from records with ``record_id``, ``id``, ``commits`` and ``commits_json``."""
    return NestedTables(_read(df, "record_id", "id", "commits_json", typed=_typed_commit, document=_commit_of))


def all_runs(df: DataFrame, *columns: str, with_jobs: bool = True) -> DataFrame:
    """``columns`` and commits, with all their validation jobs (``jobs``, with ``steps``) if asked for, whichever collector wrote the record."""
    typed, document = (_typed_run, _run_of) if with_jobs else (_typed_fields, _fields_of)
    return _read(df, *columns, typed=typed, document=document).drop("record_state")
