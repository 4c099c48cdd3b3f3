"""Sources mixed to target shares of their tokens (problem 8).

The weights of the sources lie on a path of powers. With targets: natural share ** (1 - a) * target share ** a, the targets at
a = 1, what the corpus has at a = 0; for a wanted total, bisection finds the largest exponent at which no source must be repeated
more often than it may; without one, the total is the largest at which the targets themselves hold. Without targets of its own
a mix takes shares proportional to tokens ** a, bisected to a wanted entropy. Each weight becomes a budget of tokens, and a budget
whole passes over the source and documents along a permutation of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZERS, VOCABULARY, encoding
from weftline.sources.shared import kept

#: A permutation is cut into so many blocks; only a block in which a gap ends is put in order row by row.
BLOCKS = 65_536
#: Targets are fetched to the driver, so their number is checked.
MAX_SOURCES = 10_000


def _counter(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], sizes], names=["doc_id", "source", "n_tokens"])

    return run


def token_sizes(df: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of every row; null and empty texts have none."""
    slim = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return slim.mapInArrow(_counter(folder, vocabulary), "doc_id bigint, source string, n_tokens bigint")


def entropy(weights: Sequence[float]) -> float:
    w = np.asarray([x for x in weights if x > 0], float)
    w = w / w.sum() if len(w) else w
    return float(-(w * np.log(w)).sum())


def bisected(good: Callable[[float], bool], low: float, high: float) -> float:
    """The end of low..high, next to ``high``, of the stretch from ``low`` on which ``good`` holds; good(low) is taken for granted."""
    if good(high):
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def _limits(tokens: Sequence[float], repeats: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    n = np.asarray(tokens, float)
    return n, n * np.maximum(np.asarray(repeats, float), 0)


def budgets(tokens: Sequence[float], targets: Sequence[float], repeats: Sequence[int], total: float | None = None) -> tuple[np.ndarray, float]:
    """Tokens to take per source, and the exponent used.

    A source without tokens, target or allowed repeats gets nothing, its share going to the others in proportion. With no
    total, the exponent is 1 and the total the largest at which every remaining source reaches its share of it. With a
    total that the sources can't fill even at exponent 0, every source gives all it may.
    """
    (n, most), goal = _limits(tokens, repeats), np.asarray(targets, float)
    open_ = (most > 0) & (goal > 0)
    if not open_.any():
        return np.zeros(len(n)), 1.0
    goal = np.where(open_, goal, 0) / goal[open_].sum()
    if total is None:
        with np.errstate(over="ignore"):  # a target next to nothing bounds nothing
            return goal * (most[open_] / goal[open_]).min(), 1.0
    natural = np.where(open_, n, 0) / n[open_].sum()

    def weights(a: float) -> np.ndarray:
        w = np.zeros(len(n))
        w[open_] = natural[open_] ** (1 - a) * goal[open_] ** a
        return w / w.sum()

    fits = lambda a: bool((weights(a) * total <= most * (1 + 1e-12)).all())
    if not fits(0.0):
        return np.minimum(weights(0.0) * total, most), 0.0
    at = bisected(fits, 0.0, 1.0)
    return weights(at) * total, at


def entropy_budgets(tokens: Sequence[float], repeats: Sequence[int], total: float, wanted: float) -> tuple[np.ndarray, float]:
    """Tokens to take per source at shares proportional to tokens ** a, and a.

    The exponent is bisected to the wanted entropy; where a source would then be repeated too often for the total, it is bisected
    once more, from there towards 1 (the corpus as it is), to the least at which none is. A total that the corpus can't fill
    even so is filled as far as it goes.
    """
    n, most = _limits(tokens, repeats)
    n = np.where(most > 0, n, 0.0)
    if not n.any():
        return np.zeros(len(n)), 1.0
    logs = np.log(np.maximum(n, 1e-300) / n.max())

    def weights(a: float) -> np.ndarray:
        w = np.where(n > 0, np.exp(a * logs), 0.0)
        return w / w.sum()

    at = 1.0 - bisected(lambda b: entropy(weights(1.0 - b)) <= wanted, 0.0, 1.0)
    fits = lambda a: bool((weights(a) * total <= most * (1 + 1e-12)).all())
    if not fits(1.0):
        return np.minimum(weights(1.0) * total, most), 1.0
    at = 1.0 - bisected(lambda b: fits(1.0 - b), 0.0, 1.0 - at)
    return weights(at) * total, at


def plan(sized: DataFrame, targets: DataFrame, total: float | None = None, whole: bool = False, by_entropy: bool = False) -> DataFrame:
    """One row per source of the targets or of the documents: source, target_share, max_repeats, n_available, wanted_share, budget.

    Targets of one source are added up, their largest max_repeats holding; a null or negative share counts as 0. whole: the
    total is that of the tokens of all sources that have a target and may be used. by_entropy: the shares follow the corpus'
    own, flattened or sharpened to the entropy of the targets (see entropy_budgets). wanted_share: the target among the sources
    that can give anything, the raw target for others.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("n_available"))
    wanted = (
        targets.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.coalesce(F.sum(F.greatest(F.col("target_share"), F.lit(0.0))), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("int").alias("max_repeats"))
    )
    rows = wanted.join(have, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    usable = [(r["n_available"] or 0) > 0 and r["target_share"] > 0 and r["max_repeats"] > 0 for r in rows]
    if whole or by_entropy:
        total = float(sum(r["n_available"] for r, u in zip(rows, usable) if u)) if total is None else total
    tokens, repeats = [(r["n_available"] or 0) if u else 0 for r, u in zip(rows, usable)], [r["max_repeats"] for r in rows]
    if by_entropy:
        given, _ = entropy_budgets(tokens, repeats, total, entropy([r["target_share"] if u else 0 for r, u in zip(rows, usable)]))
    else:
        given, _ = budgets(tokens, [r["target_share"] for r in rows], repeats, total)
    open_share = sum(r["target_share"] for r, u in zip(rows, usable) if u)
    made = sized.sparkSession.createDataFrame([(r["source"], float(b), float(r["target_share"] / (open_share if u else 1.0))) for r, b, u in zip(rows, given, usable)], "source string, budget double, wanted_share double")
    table = have.join(wanted, "source", "full").join(F.broadcast(made), "source", "left")
    return table.select("source", "target_share", "max_repeats", F.coalesce("n_available", F.lit(0)).cast("bigint").alias("n_available"), "wanted_share", F.coalesce("budget", F.lit(0.0)).alias("budget"))


#: A budget counts as filled within this share of itself; what is short of it is filled on in at most so many rounds.
FILLED, ROUNDS = 0.001, 24


def _walk(docs: DataFrame, active: DataFrame) -> DataFrame:
    """One round of filling: per source, from where it stands in its permutation (``lo``), the documents that fit into the gap
    one by one are added up to the first that doesn't fit after the others: source, used, stop (null where none is left)."""
    some = docs.join(F.broadcast(active), "source").filter((F.col("place") > F.col("lo")) & (F.col("n_tokens") <= F.col("gap")))
    # Tokens before each block: at most BLOCKS rows a source.
    blocks = some.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"), F.max("gap").alias("gap"))
    over = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = blocks.withColumn("until", F.sum("in_block").over(over))
    whole = ends.filter(F.col("until") <= F.col("gap")).groupBy("source").agg(F.max("until").alias("before"))
    last = ends.filter(F.col("until") > F.col("gap")).groupBy("source").agg(F.min("block").alias("block"))
    edge = some.join(F.broadcast(last), ["source", "block"]).join(F.broadcast(whole), "source", "left")
    order = Window.partitionBy("source").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("until", F.coalesce("before", F.lit(0)) + F.sum("n_tokens").over(order))
    stops = edge.groupBy("source").agg(F.max(F.when(F.col("until") <= F.col("gap"), F.col("until"))).alias("within"), F.min(F.when(F.col("until") > F.col("gap"), F.col("place"))).alias("stop"))
    return whole.join(stops, "source", "full").select("source", F.coalesce("within", "before", F.lit(0)).alias("used"), "stop")


def realise(sized: DataFrame, planned: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, copies of the documents taken at least once.

    A source gives its budget's whole number of passes; the rest is filled along a permutation of it, a document that is too
    large for what is left being passed over, and if all that fit are used, once more along it, as often as repeats
    allow. What then is short by more than half of the smallest document left is filled by that one. No document exceeds its source's max_repeats. Documents without tokens, source or target aren't taken.
    The permutation orders by a hash of the id, so a repeated task gives the same. Rows of sources, at most MAX_SOURCES, are
    fetched in each round, never those of documents.
    """
    spark = sized.sparkSession
    sources = planned.filter((F.col("budget") > 0) & (F.col("n_available") > 0)).select("source", "budget", "n_available", "max_repeats").collect()
    docs = sized.filter(F.col("n_tokens") > 0).withColumn("place", F.xxhash64("doc_id", F.lit(seed)))
    docs = docs.withColumn("block", F.shiftrightunsigned("place", 64 - (BLOCKS.bit_length() - 1)) - F.when(F.col("place") < 0, BLOCKS).otherwise(0))  # in the order of places
    passes = {r["source"]: int(r["budget"] / r["n_available"] + 1e-9) for r in sources}
    gaps = {r["source"]: r["budget"] - passes[r["source"]] * r["n_available"] for r in sources}
    small = {r["source"]: FILLED * r["budget"] for r in sources}
    most = {r["source"]: r["max_repeats"] for r in sources}
    lows, laps, gained = dict.fromkeys(passes, -(2**63)), dict.fromkeys(passes, 0), dict.fromkeys(passes, 0)
    taken: dict[str, list[tuple[int, int, float]]] = {s: [] for s in passes}
    active = [s for s in passes if gaps[s] > small[s] and gaps[s] >= 1]
    for _ in range(ROUNDS):
        if not active:
            break
        rows = _walk(docs, spark.createDataFrame([(s, lows[s], float(gaps[s])) for s in active], "source string, lo long, gap double")).collect()
        for r in rows:
            s, stop = r["source"], r["stop"]
            taken[s].append((lows[s], 2**63 - 1 if stop is None else stop, float(gaps[s])))
            gaps[s] -= r["used"]
            gained[s] += r["used"]
            lows[s] = stop
            if stop is None:  # the permutation has ended: once more along it, as long as repeats allow and something fits
                again = gained[s] > 0 and passes[s] + laps[s] + 1 < most[s]
                laps[s], gained[s], lows[s] = laps[s] + 1, 0, -(2**63) if again else None
        active = [s for s in (r["source"] for r in rows) if lows[s] is not None and gaps[s] > small[s] and gaps[s] >= 1]
    ranges = "array<struct<lo:bigint,hi:bigint,gap:double>>"
    chosen = spark.createDataFrame([(r["source"], passes[r["source"]], r["max_repeats"], float(gaps[r["source"]]), taken[r["source"]]) for r in sources], f"source string, passes int, max_repeats int, short double, ranges {ranges}")
    marked = docs.join(F.broadcast(chosen), "source")
    inside = F.filter("ranges", lambda x: (F.col("place") > x["lo"]) & ((F.col("place") < x["hi"]) | ((x["hi"] == 2**63 - 1) & (F.col("place") == x["hi"]))) & (F.col("n_tokens") <= x["gap"]))
    marked = marked.withColumn("extra", F.size(inside))
    left = marked.filter((F.col("passes") + F.col("extra") < F.col("max_repeats")) & (F.col("n_tokens") < 2 * F.col("short")))
    last = left.groupBy("source").agg(F.min(F.struct("n_tokens", "place", "doc_id")).alias("last")).select(F.col("source").alias("s"), "last.*").collect()
    closing = spark.createDataFrame([(r["s"], r["place"]) for r in last], "source string, closing long")
    marked = marked.join(F.broadcast(closing), "source", "left").withColumn("extra", F.col("extra") + F.when(F.col("place") == F.col("closing"), 1).otherwise(0))
    copies = F.least(F.col("passes") + F.col("extra"), F.col("max_repeats"))
    return marked.filter(copies > 0).select("doc_id", "source", "n_tokens", copies.alias("copies"))


def shares(mix: DataFrame, planned: DataFrame, tolerance: float = 0.01, relative: float = 0.1) -> DataFrame:
    """Per source: what it should give, has, was asked for and gave, its share of the mix, and whether that is the target.

    A target, taken among the sources that can give anything (wanted_share), is reached within ``tolerance`` and within
    ``relative`` of its own size, and never without tokens; a source without a target has null.
    """
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_used"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("n_docs"))
    table = planned.join(used, "source", "left").fillna(0, ["n_used", "most_copies", "n_docs"])
    whole = used.agg(F.coalesce(F.sum("n_used"), F.lit(0))).scalar()
    share = F.when(whole > 0, F.col("n_used") / whole).otherwise(0.0)
    target = F.coalesce("wanted_share", F.lit(0.0))
    reached = (F.col("n_used") > 0) & (F.abs(share - target) <= F.least(F.lit(tolerance), F.when(target > 0, target * relative)))
    return table.select("source", "target_share", "wanted_share", "max_repeats", "n_available", F.round("budget").cast("bigint").alias("budget"), "n_used", "n_docs", "most_copies", share.alias("reached_share"), F.when(target > 0, reached).alias("reached"))


def mix_sources(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, folder: str = TOKENIZERS, whole: bool = False, by_entropy: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix and its plan. Sizes are counted once and written to the shared folder, as several steps read them; they are
    deleted once nothing refers to them."""
    sized = kept(token_sizes(docs, folder))
    planned = kept(plan(sized, targets, total, whole, by_entropy))
    return realise(sized, planned, seed), planned
