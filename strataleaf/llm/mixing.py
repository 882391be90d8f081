"""Mixing sources to target weights by iterative proportional fitting (built-in functions only).

Documents are counted into cells (source, language, topic). Fitting rakes the tokens that
each cell shall keep until their sums agree with a target for each source, language and
topic, all targets together being ``share`` of the tokens. No cell can keep more than it
has, so raking stops at that bound and the others make up for it. A document is then sampled
with the probability kept tokens / tokens of its cell: the kept tokens have the target
margins in expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.llm.common import WS_CLASS, cut

DIMENSIONS = ("source", "lang", "topic")
#: The default targets: present token shares to these powers (1 leaves a margin as it is), as far as
#: they can be reached: no value's target exceeds all its tokens.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Sweeps at most, and the largest change of a cell's kept share in a sweep that ends the fit.
SWEEPS, STILL = 24, 1e-9
#: Sweeps after which the lineage is cut and the change is looked at.
CUT_EVERY = 4
#: Up to so many cells, the driver rakes them.
SMALL = 20_000


def topic_of(text: Column) -> Column:
    """A coarse topic by form: contact (an address), code (symbols), figures, list (many short lines), prose."""
    length = F.greatest(F.length(text), F.lit(1))
    lines = length / (F.regexp_count(text, F.lit("\n")) + 1)
    return (
        F.when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), F.lit("contact"))
        .when(F.regexp_count(text, F.lit("[{}<>;=|]")) * 50 > length, F.lit("code"))
        .when(F.regexp_count(text, F.lit("[0-9]")) * 50 > length, F.lit("figures"))
        .when(lines < 80, F.lit("list"))
        .otherwise(F.lit("prose"))
    )


def uniform(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone, the same at every run: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def default_target(cells: DataFrame, d: str, power: float, share: float) -> DataFrame:
    """(d, _share): present shares to the power, scaled to sum one under the bound present share / share."""
    raised = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("_held"))
    raised = cut(raised.select(d, "_held", F.when(F.col("_held") > 0, F.pow("_held", F.lit(power))).otherwise(F.lit(0.0)).alias("_p")))
    held, total = raised.agg(F.sum("_held"), F.sum("_p")).first()
    if not total:
        return raised.select(d, F.lit(0.0).alias("_share"))
    bound = F.col("_held") * F.lit(1 / (held * share))
    # In the order in which values reach their bound: those before are full, the others share the rest by their powers.
    before = Window.orderBy(bound / F.col("_p"), d).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(total) - F.coalesce(F.sum("_p").over(before), F.lit(0.0))
    free = 1 - F.coalesce(F.sum(bound).over(before), F.lit(0.0))
    tried = raised.where("_held > 0").select(free.alias("free"), (free / rest).alias("level"), (bound / F.col("_p")).alias("most"))
    level = tried.where(F.col("level") <= F.col("most") + 1e-15).agg(F.max_by("level", "free")).first()[0]
    reached = bound if level is None else F.least(F.col("_p") * F.lit(level), bound)
    return raised.select(d, reached.alias("_share"))


def rake(cells: list[tuple], sweeps: int = SWEEPS) -> list[float]:
    """The tokens to keep of cells (values of DIMENSIONS, tokens, mass to start from, targets), in plain sums."""
    mass = [c[4] for c in cells]
    for _ in range(sweeps):
        before = list(mass)
        for k in range(len(DIMENSIONS)):
            held: dict = {}
            for c, m in zip(cells, mass, strict=True):
                held[c[k]] = held.get(c[k], 0.0) + m
            mass = [min(float(c[3]), m * c[5 + k] / held[c[k]]) if held[c[k]] > 0 else 0.0 for c, m in zip(cells, mass, strict=True)]
        if max((abs(m - x) / max(c[3], 1) for c, m, x in zip(cells, mass, before, strict=True)), default=0.0) <= STILL:
            break
    return mass


def fit(cells: DataFrame, share: float = 0.9, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, small: int = SMALL) -> DataFrame:
    """cells (source, lang, topic, tokens) with the tokens to keep, as ``mass``, tokens at most.

    ``targets``: for each dimension a table (value, share of the kept tokens); values
    without one keep nothing. Where bounds make targets unreachable together, the margins
    that are raked last come closest. Up to ``small`` cells are raked by the driver, more
    by grouped sums; both do the same sums.
    """
    cells = cut(cells)
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    now = cells.withColumn("_mass", F.col("tokens") * F.lit(float(share)))
    goals = [f"_target_{d}" for d in DIMENSIONS]
    for d, goal in zip(DIMENSIONS, goals, strict=True):
        wanted = targets[d].toDF(d, "_share") if targets else default_target(cells, d, POWERS[d], share)
        now = now.join(wanted.select(d, (F.col("_share") * F.lit(total * share)).alias(goal)), d, "left")
    now = cut(now.select(*DIMENSIONS, "tokens", "_mass", *goals).fillna(0.0, goals))
    if now.count() <= small:
        known = [tuple(r) for r in now.orderBy(*DIMENSIONS).collect()]
        rows = [(*c[:4], m) for c, m in zip(known, rake(known, sweeps), strict=True)]
        return cells.sparkSession.createDataFrame(rows, "source string, lang string, topic string, tokens long, mass double")
    now = now.withColumn("_before", F.col("_mass"))
    for k in range(sweeps):
        if (k + 1) % CUT_EVERY == 0:
            now = now.withColumn("_before", F.col("_mass"))
        for d, goal in zip(DIMENSIONS, goals, strict=True):
            held = F.sum("_mass").over(Window.partitionBy(d))
            raked = F.when(held > 0, F.col("_mass") * F.col(goal) / held).otherwise(F.lit(0.0))
            now = now.withColumn("_mass", F.least(F.col("tokens").cast("double"), raked))
        if (k + 1) % CUT_EVERY == 0:
            now = cut(now)
            moved = now.agg(F.max(F.abs(F.col("_mass") - F.col("_before")) / F.greatest(F.col("tokens"), F.lit(1)))).first()[0]
            if (moved or 0.0) <= STILL:
                break
    return now.select(*DIMENSIONS, "tokens", F.col("_mass").alias("mass"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", share: float = 0.9, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, seed: str = "mix", topic=topic_of, small: int = SMALL, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, probability, kept.

    n_tokens counts words. A null source or language is a value of its own, written
    ``(none)``. Null and empty texts have no token: they add nothing to a cell and are
    sampled like the others of it, and all are kept where a cell has no token. Repeated rows
    get one answer, as sampling depends on the id; null ids share one. Very long texts are
    counted as wholes. An empty table gives an empty result. Other columns are ignored, but
    for those in ``carry``: each comes back, prefixed ``in_``, from the same row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.lit("(none)")
    held = [f"in_{c}" for c in carry]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), none).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), none).alias("lang"),
        topic(text).alias("topic"),
        F.regexp_count(text, F.lit(f"[^{WS_CLASS}]+")).cast("long").alias("n_tokens"),
        *[F.col(c).alias(f"in_{c}") for c in carry],
    )
    rows = cut(rows)
    fitted = cut(fit(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), share, targets, sweeps, small))
    probability = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.col("mass") / F.col("tokens"))
    cells = fitted.select(*DIMENSIONS, probability.alias("probability"))
    if fitted.count() <= small:
        cells = F.broadcast(cells)  # SMALL rows at most
    return rows.join(cells, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "n_tokens", "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("kept"), *held)
