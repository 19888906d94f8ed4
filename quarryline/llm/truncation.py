"""Texts cut off before their end, from length limits and endings.

Sources are pairs of an analyzer and a kind of text. The log-odds of a cut are a prior from the length and the
weight of the ending, and both are fitted:

1. Length. Per source a log-normal is fitted to the histogram of lengths by maximum likelihood, right-
   censored at a candidate limit (the longest length, and lower ones that pile up and beyond which texts
   become fewer). At a limit the prior is the censoring posterior: one minus the number the uncensored
   density expects there over the number found, which the endings of the texts at the limit bring up to date by EM. Off the limits it
   is the source's own share of cuts.
2. Endings. An ending is a category: closed or not, an odd quote, a blank at the end, and the hazard, that is how often texts (where
   a source leaves out full stops: sentences) end after its last two tokens among all places where these stand or begin a longer word.
   How cuts end is known by cutting: a sample of whole texts is cut at a place drawn by hash, and these go through
   the same counts. How whole texts end is what is left of the off-limit texts without their share of
   cuts. The logarithm of the ratio is the category's weight, the same at every length, so at one ending the fit
   of the lengths decides.
3. A sign that the cutting program wrote (ellipsis, "[truncated]", a count of dropped characters, U+FFFD) is taken at its word.

Counts cover all texts, copies of longer prose once: one combinable aggregate over pairs of tokens, from which single tokens and beginnings
of words are rolled up. Only keys and small columns are joined; texts and tokens never travel. The histograms are per source and length or
category, so the fits see as many rows as there are lengths or categories, not texts.

Defined cases: null and empty texts are no elements; repeated rows count once; a null analyzer is a source
of its own; positions count null elements; very long texts are read whole; an empty table has no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.session import materialize

#: What a cutting program writes at the end.
SIGN = r"(?:\.\.\.|…|<\.\.\.>|\[\.\.\.\]|[\[(<](?i:truncated|cut|snip|more)[\])>]|\(\+\d+ (?i:chars|characters|bytes)\)|\x{FFFD})\z"
CLOSED = r"(?:[.!?。！？]+[\"'”’»)\]`]*|[\"”»)\]`])\z"
#: Prose: paths, names and numbers are one token each. Paths: every part is a token.
#: The first form is what words without anything beside them match at once; the others would come to the same.
PROSE_TOKEN = r"[\p{L}\p{M}]++(?![\p{N}_./@-])|[\w.@-]*/[\w./@-]*\w|[\p{L}\p{M}\p{N}_]*[\p{N}_](?:[\p{L}\p{M}\p{N}_.-]*[\p{L}\p{M}\p{N}_])?|[\p{L}\p{M}]+|[^\p{L}\p{M}\p{N}_\s]"
PATH_TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s]"
BOUNDARY = (".", "!", "?", ";", "。", "！", "？")
BLANKS = " \t\r\n\f\x0b"

#: A source closes its sentences if at least this share of its unsigned texts does.
STYLE_SHARE = 0.5
#: Texts beyond a limit that are no more than this share of a source may be strays.
STRAY_SHARE = 0.02
#: Analyses whose texts are cut to learn how cuts end; a bound on that sample alone.
SAMPLE = 20_000
#: Cases that the shorter ending weighs as where the longer one was hardly seen, and the hazard where nothing was.
SHRINK, BASE_HAZARD = 4.0, 0.05
#: Bins of the hazard per power of e, and how many there are.
BIN_WIDTH, BINS = 2.0, 14
#: Texts are rarer than sampled cuts where cuts end: less than this at first, and no more than so many times the share of cuts.
RARER, MISMATCH = 0.5, 10.0
#: Fewer sampled cuts tell nothing.
LEAST_CUTS = 30
#: Texts that a share known before (a style's, or a limit's censoring posterior) weighs as.
PRIOR_TEXTS = 50.0
#: Tokens up to which prose is a note: its copies count, as being written again is what shows it whole.
NOTE_TOKENS = 3


def elements(analyses: DataFrame) -> DataFrame:
    """analysis_id, analyzer, field_name, part, elem_pos, text: each non-empty text; rows repeated whole come out again."""
    text = lambda part, x: F.struct(F.lit(part).alias("part"), x.alias("text"))
    base = analyses.select("analysis_id", "analyzer", "error_context", "relevant_files")
    context = F.transform("error_context", lambda x, i: F.struct(F.lit("error_context").alias("field_name"), i.alias("elem_pos"), F.array(text("error_context", x)).alias("texts")))
    files = F.transform("relevant_files", lambda f, i: F.struct(F.lit("relevant_files").alias("field_name"), i.alias("elem_pos"), F.array(text("file", f["file"]), text("reason", f["reason"])).alias("texts")))
    both = F.concat(F.coalesce(context, F.array()), F.coalesce(files, F.array()))
    flat = F.flatten(F.transform(both, lambda e: F.transform(e["texts"], lambda t: F.struct(e["field_name"].alias("field_name"), e["elem_pos"].alias("elem_pos"), t["part"].alias("part"), t["text"].alias("text")))))
    return base.select("analysis_id", "analyzer", F.explode(flat).alias("e")).select("analysis_id", "analyzer", "e.*").filter("text <> ''")


def _prose_token(t: Column) -> Column:
    # Most tokens are letters alone: one test decides them.
    path = F.concat(F.lit("<path>"), F.regexp_extract(t, r"\w(\.[a-z]{1,5})$", 1))
    named = F.when(t == "/", t).when(t.contains("/"), path).when(t.rlike(r"^\p{N}+$"), "0").otherwise("<name>")
    return F.when(t.rlike(r"[/\p{N}_]"), named).otherwise(t)


def _tokens(text: Column, kind: Column) -> Column:
    text = F.lower(text)
    prose = F.transform(F.regexp_extract_all(text, F.lit(PROSE_TOKEN), F.lit(0)), _prose_token)
    path = F.transform(F.regexp_extract_all(text, F.lit(PATH_TOKEN), F.lit(0)), lambda t: F.when(t.rlike(r"^\p{N}"), "0").otherwise(t))
    return F.when(kind == "path", path).otherwise(prose)


def fit_limit(lengths: np.ndarray, counts: np.ndarray, at_length: int | None = None, chance: float = 1e-4) -> tuple[float, float, int | None, float]:
    """mu and sigma of the log-normal, the limit (None without one) and the censoring posterior at it.

    The candidate is the longest length, or ``at_length``; texts beyond it count as censored there."""
    order = np.argsort(lengths)
    ends = lengths[order]
    top = int(ends[-1] if at_length is None else at_length)
    own, beyond = float(counts[order][ends == top].sum()), float(counts[order][ends > top].sum())
    ends, c = ends[ends <= top], counts[order][ends <= top].astype(float)
    c[-1] += beyond
    x, total = np.log(ends.astype(float)), c.sum()
    mu = float((x * c).sum() / total)
    sigma = max(0.05, float(np.sqrt(((x - mu) ** 2 * c).sum() / total)))
    if total < 20 or len(x) < 5:
        return mu, sigma, None, 0.0
    cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    edge, below, at = math.log(top), slice(0, -1), c[-1]
    for _ in range(60):  # maximum likelihood by EM: moments of the part above the limit
        z = (edge - mu) / sigma
        tail = max(1e-12, 1 - cdf(z))
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        m1 = mu + sigma * hazard
        m2 = sigma * sigma * (1 + z * hazard - hazard * hazard) + m1 * m1
        new_mu = float(((x[below] * c[below]).sum() + at * m1) / total)
        square = float(((x[below] ** 2 * c[below]).sum() + at * m2) / total)
        new_sigma = max(0.05, math.sqrt(max(1e-6, square - new_mu * new_mu)))
        done = abs(new_mu - mu) + abs(new_sigma - sigma) < 1e-7
        mu, sigma = new_mu, new_sigma
        if done:
            break
    expected = total * (cdf((math.log(top + 0.5) - mu) / sigma) - cdf((math.log(top - 0.5) - mu) / sigma))
    # Chance of so many at one length by the density alone (Poisson, Chernoff bound).
    log_chance = _log_chance(own, expected) if own > expected else 0.0
    if own < 3 or log_chance > math.log(chance):
        return mu, sigma, None, 0.0
    return mu, sigma, top, float(min(0.999, max(0.0, 1 - expected / own)))


def _log_chance(found: float, expected: float) -> float:
    """Chernoff bound of a Poisson count as far from its mean as ``found``."""
    expected = max(expected, 1e-9)
    return found - expected - (found * math.log(found / expected) if found else 0.0)


def lower_limits(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, float]]:
    """Further limits below the longest length, with the censoring posterior at each.

    A limit is a length that stands out of those around it and of the fitted density, and beyond which texts become
    fewer: by significantly less in the window above than in the one below, or by few texts in all. Repeated notes
    and names pile up too, but texts go on beyond them as before. Chances are corrected for the lengths tried."""
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), counts[order].astype(float)
    total, out = c.sum(), []
    tried = np.flatnonzero((c >= 3) & (x < x[-1]))
    upto = np.concatenate([[0.0], np.cumsum(c)])
    within = lambda low, high: float(upto[np.searchsorted(x, high, "right")] - upto[np.searchsorted(x, low, "left")])
    chance = 1e-4 / max(1, len(tried))
    for k in tried:
        at, own, width = int(x[k]), float(c[k]), max(5, int(x[k]) // 10)
        low, high, beyond = within(at - width, at - 1), within(at + 1, at + width), total - upto[k + 1]
        near = max(low, high, 1.0) / width
        if own <= near or _log_chance(own, near) > math.log(chance):
            continue
        mu, sigma, limit, posterior = fit_limit(x, c, at, chance)
        if limit is None:
            continue
        cdf = lambda z: 0.5 * math.erfc(-(math.log(max(z, 1e-9)) - mu) / sigma / math.sqrt(2))  # noqa: B023, E731
        ratio = min(1.0, (cdf(at + width + 0.5) - cdf(at + 0.5)) / max(1e-9, cdf(at - 0.5) - cdf(at - width - 0.5)))
        fewer = high < low * ratio and _log_chance(high, low * ratio) < math.log(chance)
        if fewer or (beyond < own and beyond <= STRAY_SHARE * total):
            out.append((at, posterior))
    return out


def read_texts(analyses: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every element, and the sample's elements once more cut at a place drawn by hash (``sim``), with what is seen of a text alone."""
    n = analyses.count()
    text, last = F.col("text"), F.length("text")
    drawn = (last > 1) & (F.pmod(F.xxhash64(F.lit("drawn"), "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n))))
    place = (F.lit(1) + F.pmod(F.xxhash64(F.lit("place"), "text"), F.greatest(last - 1, F.lit(1)))).cast("int")
    rows = elements(analyses).withColumn("place", F.explode(F.when(drawn, F.array(F.lit(0), place)).otherwise(F.array(F.lit(0)))))
    kind = F.when(F.col("part") == "file", "path").otherwise("prose")
    sim, trimmed = F.col("place") > 0, lambda t: F.rtrim(t, F.lit(BLANKS))
    after = F.substring(text, F.col("place") + 1, F.lit(1))
    word = r"[\p{L}\p{M}\p{N}_]"
    rows = rows.select(
        "analysis_id", "analyzer", "field_name", "part", "elem_pos", kind.alias("kind"), sim.alias("sim"), F.xxhash64("text").alias("h"), F.length("text").alias("len"),
        F.when(sim, F.left(text, F.col("place"))).otherwise(text).alias("text"), (sim & F.right(trimmed(text), F.lit(40)).rlike(SIGN)).alias("whole_signed"), (sim & F.right(trimmed(text), F.lit(40)).rlike(CLOSED)).alias("whole_closed"),
        (sim & after.rlike(word)).alias("goes_on"), (sim & after.isin(*BOUNDARY)).alias("bounds"),
    )
    end, quotes = F.right(trimmed(F.col("text")), F.lit(40)), F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    rows = rows.select(
        "*", end.rlike(SIGN).alias("signed"), (end.rlike(CLOSED) & (F.pmod(quotes, F.lit(2)) == 0)).alias("closed"), (F.pmod(quotes, F.lit(2)) == 1).alias("odd"),
        end.rlike(r"/[\p{L}\p{M}\p{N}_-]+\.\z").alias("bare_path"), F.right("text", F.lit(1)).isin(*BLANKS).alias("blank"), end.rlike(rf"{word}\z").alias("in_word"), _tokens(F.col("text"), F.col("kind")).alias("t"),
    )
    back = lambda k: F.coalesce(F.get("t", F.size("t") - k), F.lit(""))
    mid = F.col("sim") & F.col("goes_on") & F.col("in_word")
    return rows.select("*", F.size("t").alias("n_tokens"), back(1).alias("w"), back(2).alias("c"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"), mid.alias("mid")).drop("text", "goes_on", "in_word")


def length_limits(texts: DataFrame) -> DataFrame:
    """analyzer, part, len_limits, censorings, closes: one row per source, from its distinct unsigned texts (copies are no pile)."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        lengths, n = rows["len"].to_numpy(), rows["n"].to_numpy()
        *_, limit, posterior = fit_limit(lengths, n)
        limits = ([] if limit is None else [(limit, posterior)]) + lower_limits(lengths, n)
        return pd.DataFrame({"analyzer": [rows["analyzer"].iloc[0]], "part": [rows["part"].iloc[0]], "len_limits": [[k for k, _ in limits]], "censorings": [[p for _, p in limits]], "closes": [float(rows["closed"].sum() / n.sum())]})

    unsigned = texts.filter("not sim and not signed").groupBy("analyzer", "part", "len", "h").agg(F.max(F.col("closed").cast("int")).alias("closed"))
    histogram = unsigned.groupBy("analyzer", "part", "len").agg(F.sum("closed").alias("closed"), F.count("*").alias("n"))
    return histogram.groupBy("analyzer", "part").applyInPandas(fit, "analyzer string, part string, len_limits array<int>, censorings array<double>, closes double")


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.analyzer").eqNullSafe(F.col(f"{b}.analyzer")) & (F.col(f"{a}.part") == F.col(f"{b}.part"))


def _styled(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """``texts`` with the censoring posterior at their length (null off the limits) and the style of their source."""
    at = F.get("censorings", F.array_position("len_limits", F.col("len")).cast("int") - 1)
    style = F.when(F.col("kind") == "path", "path").when(F.coalesce("closes", F.lit(0.0)) >= STYLE_SHARE, "closing").otherwise("open")
    return texts.alias("e").join(limits.alias("l"), _same_source("e", "l"), "left").select("e.*", at.alias("censoring"), F.when(at.isNotNull(), F.col("len")).otherwise(0).alias("limit"), style.alias("style"))


def _once() -> Column:
    """Whether copies of a text count once: they say no more about its ending than one of them, except of notes and paths."""
    return (F.col("kind") == "prose") & (F.col("n_tokens") > NOTE_TOKENS)


def _pair_counts(styled: DataFrame) -> DataFrame:
    """kind, c, w: how often the tokens c w stand in a text and go on (``goes``), end a sentence (``bounds``) or a text of a style (``ends``)."""
    counted = styled.filter("not sim")
    once = _once()
    copies = materialize(counted.filter(once).groupBy("style", "h").agg(F.count("*").alias("copies")).filter("copies > 1"))
    weighed = counted.select("kind", "style", F.when(once, F.col("h")).alias("h"), "t").join(copies, ["style", "h"], "left").withColumn("weight", 1 / F.coalesce("copies", F.lit(1)))

    def at(w: Column, i: Column) -> Column:
        after = F.get("t", i + 1)
        return F.struct(F.when(i > 0, F.get("t", i - 1)).otherwise("").alias("c"), w.alias("w"), F.when(after.isNull(), 2).when(after.isin(*BOUNDARY), 1).otherwise(0).alias("then"))

    rows = weighed.select("kind", "style", "weight", F.explode(F.transform("t", at)).alias("p")).select("kind", "style", "weight", "p.*")
    share = lambda x: F.sum(F.when(x, F.col("weight")).otherwise(0.0))
    then, open_ = F.col("then"), F.col("style") == "open"
    return rows.groupBy("kind", "c", "w").agg(share(then == 0).alias("goes"), share(then == 1).alias("bounds"), share((then == 2) & open_).alias("ends_open"), share((then == 2) & ~open_).alias("ends_other"))


_COUNTS = ("goes", "bounds", "ends_open", "ends_other", "longer")


def _known(pairs: DataFrame, key: list[str], asked: DataFrame) -> DataFrame:
    """Per asked key its counts in ``pairs``, and those of longer words that it begins (``longer``)."""
    counts = pairs.groupBy("kind", *key).agg(*[F.sum(k).alias(k) for k in _COUNTS[:-1]]) if len(key) == 1 else pairs
    size = F.length("w")
    itself = F.struct(F.col("w"), *_COUNTS[:-1], F.lit(0.0).alias("longer"))
    nothing = [F.lit(0.0).alias(k) for k in _COUNTS[:-1]]
    begun = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda k: F.struct(F.left("w", k).alias("w"), *nothing, sum(map(F.col, _COUNTS[:-1]), F.lit(0.0)).alias("longer")))
    begins = (size > 1) & F.col("w").rlike(r"^[\p{L}\p{M}]+$")
    spread = counts.select("kind", *key[:-1], F.explode(F.concat(F.array(itself), F.when(begins, begun).otherwise(F.array()))).alias("x")).select("kind", *key[:-1], "x.*")
    wanted = asked.select("kind", *key).distinct()
    # Sums are rounded so that their order changes nothing.
    return spread.join(wanted, ["kind", *key], "left_semi").groupBy("kind", *key).agg(*[F.round(F.sum(k), 3).alias(f"{k}{len(key)}") for k in _COUNTS])


def _hazard(order: int, below: Column) -> Column:
    """How often a text ends after the last ``order`` tokens, without the text itself, shrunk to the order below."""
    goes, bounds, ends_open, ends_other, longer = (F.coalesce(F.col(f"{k}{order}"), F.lit(0.0)) for k in _COUNTS)
    open_ = F.col("style") == "open"
    # A whole text is counted among the ends; a cut one where it was cut. Bounds are ends where full stops are left out.
    itself = F.when(F.col("sim"), F.when(F.col("bounds") & ~F.col("mid") & open_, 1.0).otherwise(0.0)).otherwise(1.0)
    ended = F.greatest(F.when(open_, ends_open + bounds).otherwise(ends_other) - itself, F.lit(0.0))
    others = F.greatest(goes + longer + F.when(open_, 0.0).otherwise(bounds) - (1.0 - itself), F.lit(0.0))
    return (ended + SHRINK * below) / (ended + others + SHRINK)


def _note_starts(styled: DataFrame) -> DataFrame:
    """style, first: how many texts of closing sources begin with that token, and how many of them are not closed."""
    rows = styled.filter("style = 'closing' and not sim and not signed").groupBy("style", "first", "h").agg(F.max(F.col("closed").cast("int")).alias("closed"))
    return rows.groupBy("style", "first").agg(F.count("*").alias("starts"), F.sum(1 - F.col("closed")).alias("open_starts"))


def categories(styled: DataFrame) -> DataFrame:
    """``styled`` without tokens, with the category of the ending."""
    # Signed texts and closed prose are judged without their last words.
    judged = ~F.col("signed") & ((F.col("kind") == "path") | ~F.col("closed"))
    narrow = styled.drop("t")
    rest, narrow = narrow.filter(~judged), narrow.filter(judged)
    asked = narrow.select("kind", "c", "w").distinct()
    pairs = materialize(_pair_counts(styled))  # counted once for both orders
    known = asked.join(_known(pairs, ["c", "w"], asked), ["kind", "c", "w"], "left").join(_known(pairs, ["w"], asked), ["kind", "w"], "left")
    rows = narrow.join(known, ["kind", "c", "w"], "left").join(_note_starts(styled), ["style", "first"], "left")
    hazard = _hazard(2, _hazard(1, F.lit(BASE_HAZARD)))
    bins = F.lpad(F.least(F.floor(-F.log(hazard) * BIN_WIDTH), F.lit(BINS)).cast("string"), 2, "0")
    # Short notes begin alike and are hardly ever closed.
    own = F.when(F.col("sim"), 0).otherwise(1)
    note = F.when(F.coalesce("open_starts", F.lit(0)) - own > F.lit(0.5) * (F.coalesce("starts", F.lit(0)) - own), "note").otherwise("")
    marks = F.concat_ws(" ", F.when((F.col("kind") == "prose") & F.col("odd"), "odd"), F.when(F.col("blank"), "blank"), F.when(F.col("style") == "closing", note))
    columns = ["analysis_id", "analyzer", "field_name", "part", "elem_pos", "style", "sim", "signed", "whole_signed", "whole_closed", "censoring", "limit", "h", _once().alias("once")]
    by_ending = rows.select(*columns, F.concat(F.lit("open "), bins, F.lit(" "), marks).alias("category"))
    return by_ending.unionByName(rest.select(*columns, F.when(F.col("signed"), "signed").when(F.col("bare_path"), "closed path").otherwise("closed").alias("category")))


def fit_endings(found: np.ndarray, cut: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The share of cuts, and how cuts and whole texts end, from counts per category of off-limit texts and of sampled cuts.

    A category in which texts are much rarer than sampled cuts holds cuts; their number over the sampled cuts' part there is the share,
    and categories that hold far more than this share allows are taken out again. The cuts of the texts may not fall where the sample's do, so
    within those categories they show themselves how cuts end."""
    k = max(1, len(found))
    total, drawn = float(found.sum()), float(cut.sum())
    q = (cut + 0.5) / (drawn + 0.5 * k)
    share, cuts = 0.01, np.zeros(len(found), bool)
    if total and drawn >= LEAST_CUTS:
        ratio = found / (total * q)
        wider, cuts = cuts, ratio < RARER
        while cuts.any() and (cuts != wider).any():
            share = found[cuts].sum() / (total * q[cuts].sum())
            wider, cuts = cuts, cuts & (ratio <= MISMATCH * share)
    share = min(0.5, max(0.001, float(share)))
    if cuts.any():
        own = found[cuts] + PRIOR_TEXTS * q[cuts] / q[cuts].sum()
        q[cuts] = q[cuts].sum() * own / own.sum()
    whole = np.where(cuts, 0, np.maximum(found - share * total * q, 0)) + 0.5
    return share, q, whole / whole.sum()


def group_share(found: np.ndarray, q: np.ndarray, whole: np.ndarray, before: float) -> float:
    """The share of cuts among texts of one source and length limit by EM, with ``before`` as ``PRIOR_TEXTS`` texts."""
    total, own = float(found.sum()), before
    for _ in range(200):
        own_next = (float((found * own * q / (own * q + (1 - own) * whole)).sum()) + PRIOR_TEXTS * before) / (total + PRIOR_TEXTS)
        if abs(own_next - own) < 1e-9:
            break
        own = own_next
    return min(0.999, max(0.0005, own))


def ending_weights(judged: DataFrame) -> DataFrame:
    """analyzer, part, limit, category, weight, prior: the log ratio of each ending, and the log-odds of a cut at each limit of a source and off them (limit 0)."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        sums = rows.assign(free=rows["n_found"].where(rows["limit"] == 0, 0)).groupby("category")[["free", "n_cut"]].sum()
        share, q, whole = fit_endings(sums["free"].to_numpy(float), sums["n_cut"].to_numpy(float))
        at = {c: i for i, c in enumerate(sums.index)}
        out = []
        for (analyzer, part, limit), own in rows.groupby(["analyzer", "part", "limit"], dropna=False):
            k = own["category"].map(at).to_numpy()
            p = group_share(own["n_found"].to_numpy(float), q[k], whole[k], float(own["censoring"].iloc[0]) if limit else share)
            out.append(pd.DataFrame({"analyzer": None if pd.isna(analyzer) else analyzer, "part": part, "limit": limit, "category": own["category"].to_numpy(), "weight": np.log(q[k] / whole[k]), "prior": math.log(p / (1 - p))}))
        return pd.concat(out)

    # A cut of a closing source is one of a closed text. Cuts are drawn at all lengths, so they count off the limits.
    cut = F.col("sim") & ~F.col("whole_signed") & ((F.col("style") != "closing") | F.col("whole_closed"))
    limit = F.when(F.col("sim"), 0).otherwise(F.col("limit")).alias("limit")
    source = ["style", "analyzer", "part", limit, "category"]
    texts = judged.groupBy(*source, "sim", "once", "h").agg(F.max("censoring").alias("censoring"), F.count_if(~F.col("sim") & ~F.col("signed")).alias("n"), F.count_if(cut).alias("n_cut"))
    n = F.when(F.col("once"), F.least("n", F.lit(1))).otherwise(F.col("n"))
    rows = texts.groupBy("style", "analyzer", "part", "limit", "category").agg(F.max("censoring").alias("censoring"), F.sum(n).alias("n_found"), F.sum("n_cut").alias("n_cut"))
    return rows.groupBy("style").applyInPandas(fit, "analyzer string, part string, limit int, category string, weight double, prior double")


def scored(analyses: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every element with its ``category``, length ``limit`` (0 off the limits) and log-odds ``score``."""
    texts = materialize(read_texts(analyses, sample))  # read once, tokenised once
    styled = _styled(texts, materialize(length_limits(texts)))
    judged = materialize(categories(styled))
    weights = materialize(ending_weights(judged))
    same = _same_source("e", "f") & (F.col("e.limit") == F.col("f.limit")) & (F.col("e.category") == F.col("f.category"))
    rows = judged.filter("not sim").alias("e").join(weights.alias("f"), same, "left").select("e.*", "f.weight", "f.prior")
    return rows.withColumn("score", F.when(F.col("signed"), F.lit(float("inf"))).otherwise(F.col("prior") + F.col("weight")))


def cut_elements(scores: DataFrame) -> DataFrame:
    """analysis_id, field_name, elem_pos of elements with a text that was cut off."""
    return scores.filter("score > 0").select("analysis_id", "field_name", "elem_pos").distinct()


def cut_share(scores: DataFrame) -> DataFrame:
    """Per analyzer and field: elements, how many are cut, and their share."""
    per = scores.groupBy("analyzer", "field_name", "analysis_id", "elem_pos").agg(F.max((F.col("score") > 0).cast("int")).alias("cut"))
    counts = per.groupBy("analyzer", "field_name").agg(F.count("*").alias("n_elements"), F.sum("cut").alias("n_cut"))
    return counts.withColumn("share", F.col("n_cut") / F.col("n_elements"))
