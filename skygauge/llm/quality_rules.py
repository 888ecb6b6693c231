"""Quality rules learned as a decision list, applied as one ordered Spark expression.

Statistics of a text are DataFrame expressions; nothing of the main path runs Python on the executors. The list is
learned by sequential covering from a bounded sample of labelled rows: each rule is a conjunction of thresholds that
grows by information gain on two thirds of the sample, is pruned on the rest, and is kept while it is precise there;
the rows it covers leave, and the next rule is learned. The result is `case when .. then .. end` text.

The sample is the `SAMPLE_ROWS` labelled documents with the smallest id hash; this bound is the only sampling. All
documents are judged.

Defined cases: a null or empty text has zero words and fails the base rule; labels that are null, missing or of one
class only teach no rule, so that the base rule alone decides; a document labelled twice counts twice; ties between
thresholds go to the first feature and the smaller threshold; an empty table gives an empty result; columns named
like the added ones are replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import SPACE, field, packed

SAMPLE_ROWS = 4_000
THRESHOLDS = 24
MIN_PRECISION = 0.9
MIN_COVER = 3
MAX_RULES = 16
MAX_CONDITIONS = 4

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that the rules test; all are defined for a text with words.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbol_rate": "n_symbols / n_words",
    "dup_line_rate": "n_dup_lines / n_words",
    "repeat_rate": "n_repeat_words / n_words",
    "length": "cast(n_words as double)",
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

# A word is in a repeated window if one of the windows that start at it or up to two words before is repeated. Texts
# without a repeated window, seen by hash set, skip the sort. A lambda over `array(x)` binds x once.
_REPEATS = """
case when size(array_distinct(g)) = size(g) then 0L else
  transform(array(array_sort(transform(g, (x, i) -> struct(x as h, i as i)))), s ->
    transform(array(array_sort(transform(
        filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h)
                         or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i))), p ->
      aggregate(sequence(1, size(p) - 1), 3L, (sum, k) -> sum + least(3, p[k] - p[k - 1])))[0])[0]
end
"""


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the five statistics of `STATS` (long)."""
    rows = packed(docs.drop(*[c for c in STATS if c != text])).withColumn("t", F.coalesce(F.col(field(text)), F.lit("")))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = rows.select("*", _once(F.array_remove(F.split("t", SPACE), "").alias("w"), lines.alias("l")))
    windows = F.expr(
        "case when size(w) < 3 then cast(array() as array<bigint>)"
        " else transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) end"
    )
    hashed = split.select("*", _once(windows.alias("g")))
    symbols = F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))
    return hashed.select(
        "row.*",
        _once(
            F.size("w").cast("long").alias("n_words"),
            F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
            F.expr(_REPEATS).alias("n_repeat_words"),
        ),
    )


def _once(*columns: Column) -> Column:
    """Columns from a generator of one row: no later filter or projection can copy their expressions into itself."""
    return F.inline(F.array(F.struct(*columns)))


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"

    def holds(self, values: dict[str, float]) -> bool:
        return (values[self.feature] > self.threshold) == self.above


Rule = tuple[Condition, ...]
Row = tuple[dict[str, float], bool]  # features, low quality


def _covered(rule: Rule, rows: list[Row]) -> list[Row]:
    return [r for r in rows if all(c.holds(r[0]) for c in rule)]


def _cuts(rows: list[Row]) -> list[Condition]:
    """Middles between neighbouring values at the quantiles of each feature."""
    out = []
    for name in FEATURES:
        values = sorted({r[0][name] for r in rows})
        spots = {min(len(values) - 1, max(1, round(k * len(values) / (THRESHOLDS + 1)))) for k in range(1, THRESHOLDS + 1)}
        # besides the quantiles, every place where the class changes between the two extremes of a class
        for bad in (True, False):
            own = [r[0][name] for r in rows if r[1] == bad]
            if own:
                spots |= {i for i, v in enumerate(values) if i and (values[i - 1] == max(own) or v == min(own))}
        for i in sorted(spots):
            if 0 < i < len(values):
                cut = (values[i - 1] + values[i]) / 2
                out += [Condition(name, True, cut), Condition(name, False, cut)]
    return out


def _gain(before: list[Row], after: list[Row]) -> float:
    p0, p1 = sum(r[1] for r in before), sum(r[1] for r in after)
    if not p0 or not p1:
        return 0.0
    return p1 * (math.log2(p1 / len(after)) - math.log2(p0 / len(before)))


def _grow(rows: list[Row]) -> Rule:
    rule, left = (), rows
    while len(rule) < MAX_CONDITIONS and not all(r[1] for r in left):
        tried = [(_gain(left, [r for r in left if c.holds(r[0])]), c) for c in _cuts(left)]
        best = max(tried, key=lambda x: x[0], default=(0.0, None))
        if best[0] <= 1e-9:
            break
        rule += (best[1],)
        left = [r for r in left if best[1].holds(r[0])]
    return rule


def _worth(rule: Rule, rows: list[Row]) -> float:
    hit = _covered(rule, rows)
    p = sum(r[1] for r in hit)
    return (2 * p - len(hit)) / len(hit) if hit else -1.0


def learn_list(grow: list[Row], prune: list[Row]) -> list[Rule]:
    """Sequential covering over rows (features, is low quality)."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(r[1] for r in grow):
        rule = _grow(grow)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, prune))
        hit, held = _covered(rule, grow), _covered(rule, prune)
        seen = hit + held
        if len(seen) < MIN_COVER or sum(r[1] for r in seen) < MIN_PRECISION * len(seen):
            break
        if held and sum(r[1] for r in held) < MIN_PRECISION * len(held):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r[0]) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r[0]) for c in rule)]
    return rules


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """The decision list for `docs` from `labels` (quality 0: low), learned on at most `sample_rows` labelled rows."""
    picked = (
        labels.select(F.col(doc_id).alias("_id"), F.col(quality).alias("_quality"))
        .where("_id is not null and _quality is not null")
        .orderBy(F.xxhash64("_id"), "_id", "_quality")
        .limit(sample_rows)
    )
    # the sample has at most `sample_rows` rows, so the broadcast is bounded
    known = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(
        F.broadcast(picked), F.col("_doc") == F.col("_id")
    )
    found = (
        with_stats(known, "_text")
        .where(f"not ({BASE_FAILED})")
        .select(
            F.expr("pmod(xxhash64(_id, 'fold'), 3) = 0").alias("held"),
            (F.col("_quality") == 0).alias("low"),
            *[F.expr(e).cast("double").alias(c) for c, e in FEATURES.items()],
        )
        .orderBy(*FEATURES, "low")
        .limit(2 * sample_rows)
        .collect()
    )
    rows = [(r["held"], ({c: r[c] for c in FEATURES}, r["low"])) for r in found]
    return learn_list([r for held, r in rows if not held], [r for held, r in rows if held])


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: number of the first rule that holds, null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    cases = " ".join(
        f"when {' and '.join(c.sql() for c in rule)} then {i}" for i, rule in enumerate(rules, 1)
    )
    return F.expr(f"case when n_words = 0 then null {cases} end")


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """`docs` with the statistics, `base_failed`, `rule` (1-based number of the rejecting rule) and `kept`."""
    base = docs.drop(*[c for c in ("base_failed", "rule", "kept") if c != text])
    return (
        with_stats(base, text)
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
