"""Seeded permutation and bootstrap tests as relational plans.

Random choices come from an integer hash of (row, replicate), so a lost executor
recomputes the same draw and other engines can check the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.exprs import ratio
from pulsegrid.operators.ic import spearman
from pulsegrid.operators.ordering import BUCKET, average_rank
from pulsegrid.session import settle, shuffle_width

PRIME = 2147483647


def mix(row: Column, replicate: Column) -> Column:
    """Hash of two non-negative integers to [0, PRIME^2), exact in 64-bit arithmetic.

    Rows that agree modulo PRIME differ in the second half, so row numbers up to PRIME^2 hash apart.
    """
    row = row.cast("bigint")
    high = F.round((row - row % PRIME) / PRIME).cast("bigint")  # a whole multiple, below 2^31
    return _half(row, replicate) * F.lit(PRIME).cast("bigint") + _half(row + high, replicate)


def _half(row: Column, replicate: Column) -> Column:
    p = F.lit(PRIME).cast("bigint")
    h = (row.cast("bigint") % p * F.lit(48271).cast("bigint") + replicate.cast("bigint") * 69621 + 11) % p
    h = (h * h + h * F.lit(1103515245).cast("bigint")) % p
    return (h * h + replicate.cast("bigint") * 40692) % p


def replicates(df: DataFrame, n: int, name="b") -> DataFrame:
    """``n`` copies of every row. Rows are spread first: they may come out of one ordered task,
    and the copies should not be made there."""
    spread = df.repartition(shuffle_width(df.sparkSession), F.col(df.columns[0]))
    return spread.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def shuffled_position(df: DataFrame, row_id: str, replicate: str, out: str, width: int) -> DataFrame:
    """Position 1..n of each row in the replicate's random order.

    The hash is uniform, so its value ranges are the buckets: no group is sorted in
    one task, only bucket counts are scanned.
    """
    h = mix(F.col(row_id), F.col(replicate))
    b = df.withColumn("_h", h).withColumn(BUCKET, F.floor(F.floor(F.col("_h") / PRIME) * width / PRIME))
    cnt = b.groupBy(replicate, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    w0 = Window.partitionBy(replicate).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(replicate, BUCKET, F.coalesce(F.sum("_n").over(w0), F.lit(0)).alias("_off"))
    w = Window.partitionBy(replicate, BUCKET).orderBy("_h", row_id)
    return b.withColumn("_rn", F.row_number().over(w)).join(off, [replicate, BUCKET]).withColumn(
        out, F.col("_rn") + F.col("_off")).drop("_h", "_rn", "_off", BUCKET)


#: Rounds of a keyed shuffle.
ROUNDS = 24
#: Rows hashed at a time, so that intermediate arrays stay in a core's cache.
HASHED = 16_384
#: Positions of a table that are looked up together, and draws that are packed together.
TILE, CHUNK = 65_536, 4_194_304


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """Brings non-negative numbers to at most PRIME + 3 in place, equal modulo PRIME, a power of two less one."""
    for _ in range(2):
        np.right_shift(x, 31, out=spare)
        x &= PRIME
        x += spare


def _half_of(row: np.ndarray, replicate: int) -> np.ndarray:
    """``_half`` on arrays."""
    h, spare = row.astype(np.int64), np.empty(len(row), np.int64)
    _fold(h, spare)
    h *= 48271
    h += replicate * 69621 + 11
    _fold(h, spare)
    np.add(h, 1103515245, out=spare)
    h *= spare
    _fold(h, spare)
    h *= h
    h += replicate * 40692
    _fold(h, spare)
    np.multiply(h >= PRIME, PRIME, out=spare)
    h -= spare
    return h


def mix_of(row: np.ndarray, replicate: int) -> np.ndarray:
    """``mix`` on an array of row numbers."""
    h = _half_of(row, replicate)
    high = row // PRIME
    return h * PRIME + (_half_of(row + high, replicate) if high.any() else h)


def drawn(first: int, count: int, step: int, replicate: int, width: int) -> np.ndarray:
    """Draws in [0, width) of the rows ``first, first + step, ...``, sorted."""
    out = np.empty(count, np.uint32 if width <= 2**32 else np.int64)
    for i in range(0, count, HASHED):
        h = mix_of(first + step * np.arange(i, min(i + HASHED, count), dtype=np.int64), replicate)
        out[i : i + HASHED] = h - h // width * width
    out.sort()
    return out


SUMS = ("k", "sx", "sy", "sxx", "syy", "sxy")
PACKETS = "tile long, b int, length int, size int, code binary"


def packed(at: np.ndarray, b: int, length: int) -> pa.RecordBatch:
    """Sorted positions as one row per tile: a byte per gap, after a byte of 255 for every 255 that it skips, compressed."""
    at = at.astype(np.int64)
    tile = at // TILE
    first = np.flatnonzero(np.diff(tile, prepend=-1))
    gap = np.diff(at, prepend=0)
    gap[first] = at[first] % TILE
    skips = gap // 255
    end = np.arange(1, len(at) + 1) + np.cumsum(skips)
    code = np.full(end[-1] if len(at) else 0, 255, np.uint8)
    code[end - 1] = gap - 255 * skips
    cut = [0, *(end[first[1:] - 1]).tolist(), len(code)]
    parts = [code[i:j].tobytes() for i, j in zip(cut, cut[1:])] if len(at) else []
    return pa.RecordBatch.from_arrays([
        pa.array(tile[first]), pa.array(np.full(len(parts), b, np.int32)), pa.array(np.full(len(parts), length, np.int32)),
        pa.array([len(c) for c in parts], pa.int32()), pa.array([pa.compress(c, codec="zstd", asbytes=True) for c in parts], pa.binary()),
    ], ["tile", "b", "length", "size", "code"])


def unpacked(code: bytes, size: int) -> np.ndarray:
    """Positions of a packet within its tile."""
    gaps = np.frombuffer(pa.decompress(code, size, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def draw_packets(spark: SparkSession, n_replicates: int, count: int, step: int, width: int, rest: int = 0) -> DataFrame:
    """Packets of the draws of rows ``1, 1 + step, ...`` (``count`` of them) in every replicate.

    Draws follow from the row number, so none is a row: a task hashes a chunk of them and keeps about half a byte of each.
    ``rest`` is the length of one more, shorter, draw; the others have length ``step``.
    """
    chunks = max(1, -(-count // CHUNK))

    def run(batches):
        for batch in batches:
            for task in batch["id"].to_pylist():
                b, first = task // chunks + 1, task % chunks * CHUNK
                yield packed(drawn(1 + first * step, max(0, min(CHUNK, count - first)), step, b, width), b, step)
                if rest and first + CHUNK >= count:
                    yield packed(drawn(1 + count * step, 1, step, b, width), b, rest)

    total = n_replicates * chunks
    return spark.range(0, total, 1, max(1, min(total, 4 * shuffle_width(spark)))).mapInArrow(run, PACKETS)


def shuffled_to(row: np.ndarray, replicate: int, n: int) -> np.ndarray:
    """Where the replicate's shuffle of [0, n) sends each row: arithmetic on the row alone, a bijection for every n.

    Each round pairs x with k - x modulo n and swaps the two or not by a bit that both sides compute alike.
    """
    x = row.astype(np.int64)
    inside = not len(x) or x.max() < n
    sums = _half_of(np.arange(1, ROUNDS + 1) * 7919, replicate).tolist()
    for k in range(1, ROUNDS + 1):
        y = (sums[k - 1] % n + n) - x
        if inside:
            y -= n * (y >= n)
        else:
            y %= n
        top = np.maximum(x, y)
        top *= 31
        top += k
        bit = _half_of(top, replicate)
        bit >>= 16
        bit &= 1
        y -= x  # x becomes y where the bit is set
        y *= bit
        x += y
    return x


def sent_packets(df: DataFrame, row_id: str, value: str, n: int, n_replicates: int) -> DataFrame:
    """Packets of the positions that each replicate's shuffle sends the rows to, with the rows' values in the same order.

    ``value`` is a rank, a multiple of a half up to n. Rows are first gathered by number, so that a chunk's positions are dense.
    """
    kind = np.uint32 if 2 * n < 2**32 else np.uint64
    at = F.col(row_id).cast("long") - 1
    size = min(max(TILE, n // 64), CHUNK)  # rows sent at a time: many enough for dense packets, few enough for many tasks
    chunks = df.select(F.floor(at / size).alias("chunk"), at.alias("at"), (2 * F.col(value)).cast("long").alias("twice"))

    def gather(rows):
        row, twice = (rows[c].to_numpy().astype(np.int64) for c in ("at", "twice"))
        return pa.table({"rows": [row.tobytes()], "twice": [twice.astype(kind).tobytes()]})

    def run(batches):
        for batch in batches:
            for row, twice in zip(batch["rows"].to_pylist(), batch["twice"].to_pylist()):
                row, twice = np.frombuffer(row, np.int64), np.frombuffer(twice, kind)
                for b in range(1, n_replicates + 1):
                    to = np.concatenate([shuffled_to(row[i : i + HASHED], b, n) for i in range(0, len(row), HASHED)])
                    key = to * size + np.arange(len(to))
                    key.sort()
                    to = key // size
                    value = twice[key - to * size]
                    made = packed(to, b, 1)
                    cut = [*np.flatnonzero(np.diff(to // TILE, prepend=-1)).tolist(), len(to)]
                    values = [pa.compress(value[i:j].tobytes(), codec="zstd", asbytes=True) for i, j in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array(np.diff(cut), pa.int32()), pa.array(values, pa.binary())], [*made.schema.names, "n", "value"])

    # little data and much work, so the number of tasks is not left to the size of the data
    whole = chunks.repartition(4 * -(-max(n, 1) // size), "chunk").groupBy("chunk").applyInArrow(gather, "rows binary, twice binary")
    return whole.mapInArrow(run, f"{PACKETS}, n int, value binary")


def permutation_test(df: DataFrame, row_id: str, pred: str, actual: str, n_permutations=100,
                     threshold=0.05, n_buckets: int | None = None) -> DataFrame:
    """M3: null distribution of the IC under shuffled outcomes.

    Ranks are computed once and stored by position; a permutation only re-pairs them. Packets of (position sent to,
    rank) meet the other side's ranks of their tile, which gives sums per permutation. ``row_id`` must number the rows
    1..n (``row_index``).
    """
    rows = settle(df.select(row_id, pred, actual).where(F.col(pred).isNotNull() & F.col(actual).isNotNull()))
    rp = average_rank(rows, pred, n_buckets=n_buckets).select(pred, F.col("rank_avg").alias("_rp"))
    ra = average_rank(rows, actual, n_buckets=n_buckets).select(actual, F.col("rank_avg").alias("_ra"))
    ranked = rows.select(row_id, pred, actual).join(rp, pred).join(ra, actual).select(row_id, "_rp", "_ra")
    ranked = settle(ranked)  # read once per side and once for the observed value
    n = ranked.count()
    middle, kind = (n + 1) / 2, np.uint32 if 2 * n < 2**32 else np.uint64
    at = F.col(row_id).cast("long") - 1
    there = ranked.select(F.floor(at / TILE).alias("tile"), at.alias("at"), "_ra")

    def sums(key, packets, rows):
        a = np.full(TILE, np.nan)
        a[rows["at"].to_numpy() % TILE] = rows["_ra"].to_numpy() - middle
        whole = rows.num_rows == TILE
        out = []
        for b, size, code, n, value in zip(*(packets[c].to_pylist() for c in ("b", "size", "code", "n", "value"))):
            y = a[unpacked(code, size)]
            x = np.frombuffer(pa.decompress(value, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) / 2 - middle
            if not whole:  # a position that no row has pairs with nothing
                met = ~np.isnan(y)
                x, y = x[met], y[met]
            out.append((b, float(len(x)), float(x.sum()), float(y.sum()), float(x @ x), float(y @ y), float(x @ y)))
        columns = list(zip(*out)) or [()] * 7
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[1:])], ["b", *SUMS])

    tasks = n // TILE // 2 + 1  # about two tiles each at any size, so that sorting packets needs no disk
    sent = sent_packets(ranked, row_id, "_rp", n, n_permutations).repartition(tasks, "tile")
    parts = sent.groupBy("tile").cogroup(there.repartition(tasks, "tile").groupBy("tile"))
    g = parts.applyInArrow(sums, "b int, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("b").agg(*[F.sum(c).alias(c) for c in SUMS])
    k, sx, sy, sxx, syy, sxy = map(F.col, SUMS)
    spread = F.sqrt(F.nullif((sxx - sx * sx / k) * (syy - sy * sy / k), F.lit(0.0)))
    null = g.where(k > 0).select("b", ((sxy - sx * sy / k) / spread).alias("ic"))
    obs = ranked.agg(F.corr("_rp", "_ra").alias("observed_ic"))
    return null.crossJoin(F.broadcast(obs)).agg(  # one row; the null has one row per permutation
        F.max("observed_ic").alias("observed_ic"), F.count(F.lit(1)).alias("n_permutations"),
        F.avg("ic").alias("null_ic_mean"), F.stddev_pop("ic").alias("null_ic_std"),
        F.percentile("ic", 0.95).alias("null_ic_p95"),
        F.avg((F.col("ic") >= F.col("observed_ic")).cast("double")).alias("p_value"),
    ).withColumn("verdict", F.when(F.col("p_value") < threshold, "SIGNIFICANT").otherwise("SPURIOUS"))


def bootstrap_draws(df: DataFrame, row_id: str, n: int, n_boot: int) -> DataFrame:
    """The rows of ``df``, numbered 1..n by ``row_id``, that n draws with replacement meet in a replicate ``b``, and how often (``_times``)."""
    at = F.col(row_id).cast("long") - 1
    tasks = n // TILE // 2 + 1  # about two tiles each at any size
    rows = df.withColumns({"tile": F.floor(at / TILE), "_at": at}).repartition(tasks, "tile")
    out = T.StructType([T.StructField("b", T.IntegerType()), *df.schema.fields, T.StructField("_times", T.LongType())])
    names = df.columns

    def meet(key, packets, rows):
        where = np.full(TILE, -1)
        where[rows["_at"].to_numpy() % TILE] = np.arange(rows.num_rows)
        own = rows.select(names)
        parts = {}
        for b, size, code in zip(*(packets[c].to_pylist() for c in ("b", "size", "code"))):
            parts.setdefault(b, []).append(unpacked(code, size))
        made = []
        for b, drawn_at in parts.items():
            at, times = np.unique(np.concatenate(drawn_at), return_counts=True)
            met = where[at] >= 0
            t = own.take(pa.array(where[at][met])).append_column("_times", pa.array(times[met].astype(np.int64)))
            made.append(t.add_column(0, "b", pa.array(np.full(t.num_rows, b, np.int32))))
        return pa.concat_tables(made) if made else own.slice(0, 0).append_column("_times", pa.array([], pa.int64())).add_column(0, "b", pa.array([], pa.int32()))

    packets = draw_packets(df.sparkSession, n_boot, n, 1, max(1, n)).repartition(tasks, "tile")
    return packets.groupBy("tile").cogroup(rows.groupBy("tile")).applyInArrow(meet, out)


def bootstrap_ic(df: DataFrame, row_id: str, pred: str, actual: str, n_boot=50, min_n=5,
                 n_buckets: int | None = None) -> DataFrame:
    """M4: IC of each resample. Draws travel in packets and are counted, so a row is carried once per replicate."""
    rows = settle(df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull()).select(row_id, pred, actual))
    draws = settle(bootstrap_draws(rows, row_id, rows.count(), n_boot).drop(row_id))  # read for the pairs and both ranks
    return spearman(draws, pred, actual, ["b"], min_n=min_n, on_small=0.0, weight="_times", n_buckets=n_buckets)


def bootstrap_summary(ics: DataFrame, limit=0.03) -> DataFrame:
    return ics.agg(
        F.count(F.lit(1)).alias("n_bootstrap"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"),
        F.percentile("ic", 0.025).alias("ic_ci_low"), F.percentile("ic", 0.975).alias("ic_ci_high"),
    ).withColumn("verdict", F.when(F.col("ic_std") < limit, "STABLE").otherwise("UNSTABLE"))


def block_bootstrap(df: DataFrame, row_id: str, value: str, block=5, n_boot=1000, min_n=20) -> DataFrame:
    """M5: Sharpe per replicate of a moving-block resample of numbered rows 1..n.

    Fewer than ``min_n`` rows give no replicates, and so a null interval. A block is drawn by its first row; packets of
    first rows meet the values of their tile, where sums over each possible block are taken once.
    """
    df = settle(df.select(F.col(row_id).cast("long").alias("_at"), F.col(value).cast("double").alias("_v")))
    usual = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    n, low, mean, high = df.agg(F.count(F.lit(1)), F.min(usual), F.avg(usual), F.max(usual)).first()
    # sums are taken from about the mean; a constant series gives exact zeros
    centre = 0.0 if mean is None else min(max(mean, low), high)
    n_boot = n_boot if n >= min_n else 0
    packets = draw_packets(df.sparkSession, n_boot, n // block, block, max(1, n - block + 1), n % block)
    at = F.col("_at") - 1
    tiles = F.sequence(F.floor(F.greatest(at - (block - 1), F.lit(0)) / TILE), F.floor(at / TILE))  # a block may begin in the tile before
    values = df.select(F.explode(tiles).alias("tile"), at.alias("at"), "_v")

    def sums(key, rows, packets):
        v, there = np.zeros(TILE + block), np.zeros(TILE + block)
        at = rows["at"].to_numpy() - key[0].as_py() * TILE
        there[at] = rows["_v"].is_valid().to_numpy()
        v[at] = np.where(there[at] > 0, rows["_v"].to_numpy() - centre, 0.0)
        blocks = {}
        for k in np.unique(packets["length"].to_numpy()):
            blocks[k] = [sum(c[i : i + TILE] for i in range(k)) for c in (there, v, v * v)]
        out = []
        for b, k, size, code in zip(*(packets[c].to_pylist() for c in ("b", "length", "size", "code"))):
            p = unpacked(code, size)
            out.append((b, *(float(c[p].sum()) for c in blocks[k])))
        b, k, s, q = zip(*out) if out else ((), (), (), ())
        return pa.table([pa.array(b, pa.int32()), pa.array(k, pa.float64()), pa.array(s, pa.float64()), pa.array(q, pa.float64())], ["b", "k", "s", "q"])

    parts = packets.groupBy("tile").cogroup(values.groupBy("tile"))
    g = parts.applyInArrow(lambda key, p, v: sums(key, v, p), "b int, k double, s double, q double").groupBy("b").agg(
        *[F.sum(c).alias(c) for c in "ksq"])
    mean = F.col("s") / F.nullif(F.col("k"), F.lit(0.0))
    sd = F.sqrt(F.greatest(F.col("q") / F.nullif(F.col("k"), F.lit(0.0)) - mean * mean, F.lit(0.0)))
    g = g.select("b", (centre + mean).alias("_m"), sd.alias("_s"))
    return g.where(F.col("_s") > 0).select("b", (F.col("_m") / F.col("_s") * float(252 ** 0.5)).alias("sharpe"))


def sharpe_interval(boot: DataFrame, confidence=0.95) -> DataFrame:
    a = 1 - confidence
    return boot.agg(
        F.count(F.lit(1)).alias("n_bootstrap"), F.avg("sharpe").alias("sharpe_mean"),
        F.percentile("sharpe", a / 2).alias("sharpe_ci_low"), F.percentile("sharpe", 1 - a / 2).alias("sharpe_ci_high"))


def stratified_sample(df: DataFrame, strata: Sequence[str], per_stratum: int, target: int, row_id: str, seed=42) -> DataFrame:
    """Up to ``per_stratum`` rows per stratum in hash order, topped up from the rest to ``target``.

    Both steps are top-n selections: Spark keeps only the needed rows per task.
    """
    d = df.withColumn("_h", mix(F.col(row_id), F.lit(seed)))
    w = Window.partitionBy(*strata).orderBy("_h", row_id)
    first = d.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= per_stratum).drop("_i")
    picked = first.orderBy("_h", row_id).limit(target)
    rest = d.join(picked.select(row_id), row_id, "left_anti").orderBy("_h", row_id).limit(target)
    both = picked.withColumn("_p", F.lit(0)).unionByName(rest.withColumn("_p", F.lit(1)))
    return both.orderBy("_p", "_h", row_id).limit(target).drop("_h", "_p")


def significance(trades: DataFrame, pnl="pnl_pct", z=1.96) -> DataFrame:
    """M8: win counts, Wilson interval, exact binomial p values and trades needed."""
    from pulsegrid.functions.special import binomial_p_greater, binomial_p_two_sided

    g = win_interval(trades, pnl, z)
    g = g.withColumns({
        "p_two_sided": binomial_p_two_sided(F.col("n_wins").cast("double"), F.col("n_trades").cast("double")),
        "p_greater": binomial_p_greater(F.col("n_wins").cast("double"), F.col("n_trades").cast("double")),
    })
    p = F.col("win_rate")
    need = F.ceil(F.pow(ratio(F.lit(z), 2 * (p - 0.5)), F.lit(2.0)) * p * (1 - p))
    return g.withColumns({
        "significant": F.col("p_two_sided") < 0.05,
        "n_needed": F.when((F.col("p_two_sided") >= 0.05) & (p > 0.5), need),
    })


def win_interval(trades: DataFrame, pnl="pnl_pct", z=1.96) -> DataFrame:
    g = trades.agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col(pnl) > 0).alias("n_wins"))
    n, p = F.col("n_trades"), F.col("n_wins") / F.nullif(F.col("n_trades"), F.lit(0))
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z / den * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return g.select("n_trades", "n_wins", p.alias("win_rate"), (mid - half).alias("ci_low"), (mid + half).alias("ci_high"))


def return_moments(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd_pop"),
        F.stddev_samp(v).alias("sd_samp"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"))


def sharpe_significance(df: DataFrame, value: str, n_trials=50, trials_sd=0.5, benchmark=0.0, target=0.95) -> DataFrame:
    """M9: probabilistic and deflated Sharpe ratio (expected-maximum form) and the minimum
    track record; bias-corrected skew and kurtosis."""
    from math import e
    from statistics import NormalDist

    from pulsegrid.functions.special import normal_cdf

    q = NormalDist().inv_cdf
    euler = 0.5772156649
    sr0 = trials_sd * ((1 - euler) * q(1 - 1 / n_trials) + euler * q(1 - 1 / (n_trials * e)))
    m, n = return_moments(df, value), F.col("n").cast("double")
    g1 = F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurt") + 6) + 3
    sr = F.col("mean") / (F.col("sd_pop") + 1e-10)
    spread = 1 - g1 * sr + (g2 - 1) / 4 * sr * sr
    se = F.sqrt(F.greatest(spread / (n - 1), F.lit(1e-12)))
    s = m.select("n", sr.alias("sharpe"), se.alias("_se"), spread.alias("_sp"))
    enough = F.col("n") >= 10
    gap2 = (F.col("sharpe") - benchmark) * (F.col("sharpe") - benchmark)
    return s.select(
        "n", "sharpe",
        F.when(enough, normal_cdf((F.col("sharpe") - benchmark) / F.col("_se"))).otherwise(0.0).alias("psr"),
        F.when(enough, normal_cdf((F.col("sharpe") - sr0) / F.col("_se"))).otherwise(0.0).alias("dsr"),
        F.lit(sr0).alias("sr0"),
        F.when(F.col("n") < 5, 999).when(gap2 <= 0, 9999).otherwise(
            F.ceil(q(target) ** 2 * F.col("_sp") / F.nullif(gap2, F.lit(0.0)) + 1)).cast("bigint").alias("min_track_record"))


def deflated_confidence(df: DataFrame, value: str, n_folds: int) -> DataFrame:
    """M9, simple form: benchmark is the quantile of one over the number of folds."""
    from statistics import NormalDist

    from pulsegrid.functions.special import normal_cdf

    star = NormalDist().inv_cdf(1 - 1 / n_folds) if n_folds >= 2 else 0.0
    m, n = return_moments(df, value), F.col("n").cast("double")
    sr = F.col("mean") / F.coalesce(F.nullif(F.col("sd_samp"), F.lit(0.0)), F.lit(1e-9))
    var = (1 - F.col("skew") * sr + (F.col("kurt") + 2) / 4 * sr * sr) / F.greatest(n - 1, F.lit(1.0))
    zed = (sr - star) / F.coalesce(F.nullif(F.sqrt(F.abs(var)), F.lit(0.0)), F.lit(1e-9))
    ok = (F.col("n") >= 20) & F.lit(n_folds >= 2)
    return m.select("n", sr.alias("sharpe"), F.when(ok, zed).alias("z")).withColumn(
        "confidence", F.coalesce(normal_cdf("z"), F.lit(0.0)))
