"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) on a document or abstains (0). How far to trust each is estimated by
expectation-maximisation without labels: rules are taken as independent given the unknown quality, and for
either quality a rule has its own shares of good votes, bad votes and abstentions (Dawid and Skene). A
document is kept if its posterior probability of being good is high enough, and not only if it passes all
rules.

All statistics are built-in column expressions. The estimation needs only how often each pattern of votes
occurs, at most 3 ** len(RULES) rows whatever the corpus; that bounded table goes to the driver. The
posterior is again a column expression: a logistic of summed weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, discard, materialize, row_key, text_or_empty, unused

MIN_WORDS = 20
#: Largest share, in percent, of words in repeated windows.
MAX_REPEATED = 30
WINDOW = 8
#: Share of good documents on which a rule votes bad, at most.
FALSE_ALARMS = 0.01
#: Share of bad documents on which a rule votes bad, at least.
LEAST_CAUGHT = 0.05


def _statistics(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds the columns of statistics; their names start with prefix. Text mustn't be null."""
    p, space = prefix, SPACE_CLASS.replace("\\", "\\\\")
    out = rows.withColumn(f"{p}words", F.expr(f"array_remove(split(`{text}`, '{space}+'), '')"))
    out = out.withColumns(
        {
            f"{p}n_words": F.expr(f"cast(size(`{p}words`) as long)"),
            f"{p}lines": F.expr(f"filter(split(`{text}`, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
            f"{p}hashes": F.expr(f"transform(`{p}words`, w -> xxhash64(w))"),
        }
    )
    windows = f"""if(size(`{p}hashes`) < {WINDOW}, array(),
        transform(sequence(1, size(`{p}hashes`) - {WINDOW - 1}), i -> xxhash64(slice(`{p}hashes`, i, {WINDOW}))))"""
    # windows in order of their hash, so that equal ones are neighbours; positions of those; words they cover
    repeated = """transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
        aggregate(sort_array(transform(filter(s, (x, j) -> (j > 0 and get(s, j - 1).h = x.h) or (j + 1 < size(s) and get(s, j + 1).h = x.h)), x -> x.i)),
            named_struct('n', 0L, 'end', 0L),
            (a, i) -> named_struct('n', a.n + i + {w} - greatest(a.end, cast(i as long)), 'end', cast(i + {w} as long)),
            a -> a.n))[0]""".replace("{w}", str(WINDOW))
    return out.withColumns(
        {
            f"{p}word_chars": F.expr(f"cast(length(translate(`{text}`, ' \\t\\n\\u000B\\u000C\\r', '')) as long)"),
            f"{p}n_symbols": F.expr(f"cast(length(`{text}`) - length(translate(`{text}`, '#*$%&|<>', '')) as long)"),
            f"{p}n_lines": F.expr(f"cast(size(`{p}lines`) as long)"),
            f"{p}n_dup_lines": F.expr(f"cast(size(`{p}lines`) - size(array_distinct(`{p}lines`)) as long)"),
            f"{p}n_ended": F.expr(f"cast(size(filter(`{p}lines`, l -> l rlike '[.!?:;\"»”]\\\\s*$')) as long)"),
            f"{p}n_stutter": F.expr(f"cast(size(filter(`{p}hashes`, (h, i) -> i > 0 and h = get(`{p}hashes`, i - 1))) as long)"),
            f"{p}n_upper": F.expr(f"cast(length(regexp_replace(`{text}`, '[^\\\\p{{Lu}}]+', '')) as long)"),
            f"{p}n_loud": F.expr(f"cast(size(filter(`{p}words`, w -> endswith(w, '!!'))) as long)"),
            f"{p}n_repeat_words": F.expr(f"transform(array({windows}), h -> if(size(array_distinct(h)) = size(h), 0L, {repeated}))[0]"),
        }
    ).drop(f"{p}words", f"{p}lines", f"{p}hashes")


def _base_failed(p: str) -> Column:
    return F.expr(f"`{p}n_words` < {MIN_WORDS} or 100 * `{p}n_repeat_words` > {MAX_REPEATED} * `{p}n_words`")


def _rule(bad: str, good: str) -> str:
    return f"case when {bad} then -1 when {good} then 1 else 0 end"


#: Name, when it votes bad, when it votes good; it abstains otherwise. {p} is the prefix of the statistics.
RULES = [
    ("length", "{p}n_words < 20", "{p}n_words >= 100"),
    ("word_length", "{p}word_chars < 2 * {p}n_words or {p}word_chars > 14 * {p}n_words", "{p}word_chars between 3 * {p}n_words and 9 * {p}n_words"),
    ("symbols", "10 * {p}n_symbols > {p}n_words", "50 * {p}n_symbols <= {p}n_words"),
    ("repeated_lines", "2 * {p}n_dup_lines > {p}n_lines", "{p}n_lines >= 4 and {p}n_dup_lines = 0"),
    ("repeated_words", "10 * {p}n_repeat_words > 3 * {p}n_words", "20 * {p}n_repeat_words <= {p}n_words"),
    ("stutter", "5 * {p}n_stutter > {p}n_words", "25 * {p}n_stutter <= {p}n_words"),
    ("capitals", "5 * {p}n_upper > 2 * {p}word_chars", "5 * {p}n_upper <= {p}word_chars"),
    ("shouting", "5 * {p}n_loud > {p}n_words", "50 * {p}n_loud <= {p}n_words"),
    ("sentences", "5 * {p}n_ended < {p}n_lines", "5 * {p}n_ended >= 4 * {p}n_lines"),
]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over counted vote patterns.

    Returns the prior log odds of good and, for each rule, the log likelihood ratio of each vote. It starts
    with documents without a bad vote as mostly good and the rest as mostly bad. What is known of the rules beforehand bounds the
    estimates: a rule votes bad on at most FALSE_ALARMS of good documents and on at least LEAST_CAUGHT of bad ones, and no bad vote
    speaks for good nor a good one for bad.
    So a rule that the data say nothing about, or a corpus without bad documents, does no harm.
    """
    k = len(RULES)
    total = sum(n for _, n in patterns)
    if not total:
        return 0.0, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(k)]
    belief = [0.95 if -1 not in votes else 0.3 if votes.count(-1) == 1 else 0.05 for votes, _ in patterns]
    prior, weights = 0.0, []
    for _ in range(rounds):
        good = sum(b * n for b, (_, n) in zip(belief, patterns, strict=True))
        prior = math.log((good + 1) / (total - good + 1))
        weights = []
        for r in range(k):
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for b, (votes, n) in zip(belief, patterns, strict=True):
                seen[votes[r]][0] += b * n
                seen[votes[r]][1] += (1 - b) * n
            shares = {v: [g / (good + 3), b / (total - good + 3)] for v, (g, b) in seen.items()}
            shares[-1] = [min(shares[-1][0], FALSE_ALARMS), max(shares[-1][1], LEAST_CAUGHT)]
            ratio = {v: math.log(g) - math.log(b) for v, (g, b) in shares.items()}
            weights.append({-1: min(0.0, ratio[-1]), 0: max(-1.0, min(1.0, ratio[0])), 1: max(0.0, ratio[1])})
        new = [1 / (1 + math.exp(-max(-700.0, min(700.0, prior + sum(w[v] for w, v in zip(weights, votes, strict=True)))))) for votes, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(belief, new, strict=True))
        belief = new
        if moved < 1e-9:
            break
    return prior, weights


def _with_votes(rows: DataFrame, p: str) -> DataFrame:
    return rows.withColumns({f"{p}{name}": F.expr(_rule(bad.replace("{p}", p), good.replace("{p}", p))) for name, bad, good in RULES})


def _fit(voted: DataFrame, p: str) -> tuple[float, list[dict[int, float]]]:
    """Documents that fail the base rules are bad without a vote, and would hide other kinds of bad ones."""
    names = [f"{p}{name}" for name, _, _ in RULES]
    found = voted.where(~_base_failed(p)).groupBy(*names).count().orderBy(*names).collect()  # 3 ** len(RULES) rows at most
    return estimate([(tuple(r[n] for n in names), r["count"]) for r in found])


def _posterior(p: str, prior: float, weights: list[dict[int, float]]) -> Column:
    odds = F.lit(prior)
    for (name, _, _), w in zip(RULES, weights, strict=True):
        odds = odds + F.when(F.col(f"{p}{name}") == -1, w[-1]).when(F.col(f"{p}{name}") == 1, w[1]).otherwise(w[0])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the statistics, the votes (vote_*), base_failed, posterior and kept of every row.

    A null text counts as empty: no words, base_failed, not kept. A null doc_id is carried, repeated rows
    each count and get equal results. An empty table gives no rows. Other columns are ignored.
    """
    counted = _statistics(docs.select("doc_id", text_or_empty().alias("text")), "text", "").drop("text")
    named = {name: f"vote_{name}" for name, _, _ in RULES}
    voted = materialize(_with_votes(counted, ""), "rule-votes")
    prior, weights = _fit(voted, "")
    return (
        voted.withColumn("base_failed", _base_failed(""))
        .withColumn("posterior", _posterior("", prior, weights))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .withColumnsRenamed(named)
    )


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; an empty table stays empty. Statistics are computed once; what goes is a
    table of names of rows, which Spark broadcasts only if it is small."""
    row = unused("row", docs.columns)
    identity = [F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias(f"{row}_id"), row_key(F.col("doc_id"), text_or_empty()).alias(f"{row}_key")]
    texts = docs.select(*identity, text_or_empty().alias("text"))
    votes = materialize(_with_votes(_statistics(texts, "text", "").drop("text"), ""), "rule-votes")
    prior, weights = _fit(votes, "")
    bad = votes.where(_base_failed("") | ~(_posterior("", prior, weights) >= threshold))
    out = materialize(bad.select(f"{row}_id", f"{row}_key").distinct(), "rejected")
    discard(votes)
    return docs.select("*", *identity).join(out, [f"{row}_id", f"{row}_key"], "left_anti").select(*(f"`{c}`" for c in docs.columns))
