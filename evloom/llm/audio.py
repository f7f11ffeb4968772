"""Chroma audio fingerprints and alignment (operator 6).

A recording's frames become energies of twelve pitch classes.  Sixteen rectangle filters, taken
from the image's integral (four look-ups each), are quantised to two bits by Gray code and packed into one
32-bit integer a frame.  Recordings of equal prints are one class.  Two integers LAG places
apart make a landmark.  The offset histogram of two classes counts distinct equal landmarks; at the offset with most of them
the overlap's bit errors decide.  A link needs landmarks in proportion to the shorter list.  Either two of them are rare (few lists have them), and
lists meet at each of their rare landmarks; or all but one are common, so two of these stand close together in both lists:
two landmarks and their distance are joined on equality.  So no link is lost.  Lists in which common ones may stand far apart have one of those they
share among their rarest, as many as may be missing and one more, and are joined by these.
Silence makes no landmarks, for it says nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evloom.llm.common import materialise, small_batches

RATE, FRAME, HOP = 4000, 1024, 256
#: Filter kind, first pitch class, classes high, frames wide: by rule, all heights and widths in turn.
FILTERS = [(k % 4, (k * 5) % 12, 2 + k % 4, 4 + 2 * (k % 6)) for k in range(16)]
WIDTH = max(w for _, _, _, w in FILTERS)
EDGES = np.array([-0.12, 0.0, 0.12])
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Places between the two integers of a landmark.
LAG = 2
#: Distinct equal landmarks that a link needs at one offset, as a share of the shorter list's and at least; most bit errors as a share of bits; least overlap as a share of the shorter recording.
SHARE, LEAST, ERRORS, OVERLAP = 0.05, 2, 0.2, 0.5
#: Places between two landmarks of a key at most; lists that need more meet at single landmarks.
FAR = 64
#: Lists that have a landmark at most, for it to be rare; a rare one makes RARE * (RARE - 1) / 2 rows at most.
RARE = 8
HERTZ = np.fft.rfftfreq(FRAME, 1 / RATE)
AUDIBLE = (HERTZ >= 100) & (HERTZ <= 1800)
WINDOW = np.hanning(FRAME)
CLASSES = np.eye(12)[np.round(12 * np.log2(HERTZ[AUDIBLE] / 440)).astype(int) % 12]


def chroma(samples: np.ndarray) -> np.ndarray:
    """frames x 12 pitch-class energies of samples at RATE, each frame scaled to length 1; silent frames are 0."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float32), FRAME)[::HOP] * WINDOW
    out = np.sqrt(np.abs(np.fft.rfft(frames, axis=1)[:, AUDIBLE]) ** 2 @ CLASSES)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0)


def packed(image: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each place where the widest filter fits."""
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, 25))
    whole[1:, 1:] = np.concatenate([image, image], 1).cumsum(0).cumsum(1)
    t = np.arange(n)
    box = lambda t0, t1, p0, p1: whole[t1, p1] - whole[t0, p1] - whole[t1, p0] + whole[t0, p0]
    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        if kind == 0:
            a, b = box(t, t + w, p, p + h), box(t, t + w, p + h, p + 2 * h)
        elif kind == 1:
            a, b = box(t, t + w // 2, p, p + h), box(t + w // 2, t + w, p, p + h)
        elif kind == 2:
            a = box(t, t + w // 2, p, p + h) + box(t + w // 2, t + w, p + h, p + 2 * h)
            b = box(t, t + w // 2, p + h, p + 2 * h) + box(t + w // 2, t + w, p, p + h)
        else:
            a, b = box(t + w // 4, t + w - w // 4, p, p + h), box(t, t + w // 4, p, p + h) + box(t + w - w // 4, t + w, p, p + h)
        out = out << np.uint32(2) | GRAY[np.searchsorted(EDGES, np.log((1 + a) / (1 + b)))]
    return out


#: The landmark of silence.
SILENT = int((lambda x: (np.uint64(x) << np.uint64(32) | np.uint64(x)).view(np.int64))(packed(np.zeros((WIDTH, 12)))[0]))


def landmarks(prints: np.ndarray) -> np.ndarray:
    """Pairs of integers LAG places apart, as signed 64-bit integers."""
    p = prints.astype(np.uint64)
    return (p[:-LAG] << np.uint64(32) | p[LAG:]).view(np.int64) if len(p) > LAG else np.zeros(0, np.int64)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float, int]:
    """Offset (places b starts after a) with most distinct equal landmarks, the least of several; how many; the share of differing bits in the overlap there; its length."""
    x, y = landmarks(a), landmarks(b)
    order = np.argsort(y, kind="stable")
    left, right = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    times = np.where(x == SILENT, 0, right - left)
    if not times.sum():
        return 0, 0, 1.0, 0
    i = np.repeat(np.arange(len(x)), times)
    j = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(left, times)]
    once = np.unique(np.stack([i - j, x[i]]), axis=1)
    shifts, votes = np.unique(once[0], return_counts=True)
    best = np.argmax(votes)
    shift = int(shifts[best])
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    return shift, int(votes[best]), float(np.bitwise_count(a[lo:hi] ^ b[lo - shift : hi - shift]).sum() / (32 * (hi - lo))), hi - lo


def linked(a: np.ndarray, b: np.ndarray, share: float = SHARE, errors: float = ERRORS) -> tuple[int, float] | None:
    """Offset and bit errors of two linked lists of prints, else None."""
    shift, votes, wrong, overlap = align(a, b)
    count = lambda p: len(np.setdiff1d(landmarks(p), [SILENT]))
    enough = votes >= max(LEAST, share * min(count(a), count(b))) and overlap >= OVERLAP * min(len(a), len(b))
    return (shift, wrong) if enough and wrong <= errors else None


def fingerprint(media: DataFrame, render=None) -> DataFrame:
    """media_id, prints (array<int>) of media(media_id, samples array<float> or binary of 16-bit samples at RATE).

    render, if given, makes samples of what the column holds.  Null and too short recordings have no prints.
    """
    small_batches(media.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for x in b.column("samples").to_pylist():
                if render is not None and x is not None:
                    x = render(x)
                x = np.zeros(0) if x is None else np.frombuffer(x, "<i2") / 32768 if isinstance(x, bytes) else np.nan_to_num(np.array([np.nan if v is None else v for v in x] if isinstance(x, list) else x, float))
                out.append(packed(chroma(x)).view(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("media_id"), pa.array(out, pa.list_(pa.int32()))], names=["media_id", "prints"])

    return media.select("media_id", "samples").mapInArrow(run, f"media_id {dict(media.dtypes)['media_id']}, prints array<int>")


def candidates(classes: DataFrame, share: float = SHARE) -> DataFrame:
    """a < b: pairs of classes (class_id, prints) among which are all that `linked` links.

    A link's c landmarks stand at one offset.  Two rare ones among them (one, if c is two) are counted for each pair of lists; where a rare one has one
    place in both lists its offset counts, else it goes with every offset.  Otherwise all but one (need) are common, and two of these that follow each other
    are no further apart than the shorter list's span of common ones divided by need - 1 (its reach): two landmarks and the places between them
    are one key, and pairs meet at a key.  Lists whose reach is above FAR, as of drones with few landmarks in many places, meet the others at one
    landmark of their rarest common ones.
    """
    each = classes.select("class_id", F.expr(f"transform(slice(prints, 1, greatest(size(prints) - {LAG}, 0)), (x, i) -> shiftleft(cast(x as bigint), 32) | (cast(prints[i + {LAG}] as bigint) & 4294967295L))").alias("all"))
    each = each.withColumn("m", F.expr(f"array_remove(array_distinct(all), {SILENT}L)")).select("class_id", F.size("m").alias("n"), "all", "m")
    seen = materialise(each.select(F.explode("m").alias("v")).groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "landmark-counts")
    # Where landmarks that other classes have stand, in order of place.
    stand = each.select("class_id", "n", F.posexplode("all").alias("at", "v")).join(seen, "v")
    stand = stand.groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("at", "v", "df"))).alias("shared"))
    stand = stand.withColumn("c", F.greatest(F.lit(LEAST), F.ceil(F.col("n") * share))).where(f"size(array_distinct(shared.v)) >= {LEAST}")
    stand = stand.withColumn("l", F.expr(f"filter(shared, x -> x.df > {RARE})")).withColumn("common", F.expr("size(array_distinct(l.v))"))
    stand = stand.withColumn("rare", F.least(F.lit(2), F.col("c") - 1)).withColumn("need", F.expr("c - rare + 1"))
    reach = F.when(F.expr("common >= need"), F.expr("cast((l[size(l) - 1].at - l[0].at) div (need - 1) as int)")).otherwise(-1)
    stand = materialise(stand.withColumn("reach", reach), "stand")
    # A landmark's lists, the shorter first; each pair of them is a row.
    places = stand.select("class_id", "n", "c", "common", "rare", F.explode(F.expr(f"filter(shared, x -> x.df <= {RARE})")).alias("x")).select("class_id", "n", "c", "common", "rare", "x.at", "x.v")
    single = F.when(F.min("at") == F.max("at"), F.min("at")).alias("at")
    lists = places.repartition("v").groupBy("v", "class_id", "n", "c", "common", "rare").agg(single).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("n", "class_id", "c", "common", "rare", "at"))).alias("g"))
    met = "flatten(transform(g, (x, i) -> transform(slice(g, i + 2, size(g)), y -> struct(x.class_id as x, y.class_id as y, x.c, x.rare, least(x.common, y.common) as common, x.at - y.at as shift))))"
    pair = ["x", "y", "c", "rare", "common"]
    votes = lists.select(F.explode(F.expr(met)).alias("p")).select("p.*").groupBy(*pair, "shift").agg(F.count("*").alias("k")).groupBy(*pair)
    votes = votes.agg(F.expr("coalesce(max(k) filter (where shift is not null), 0) + coalesce(sum(k) filter (where shift is null), 0)").alias("votes"))
    few = votes.where("votes >= greatest(rare, c - common)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    most, fewest = stand.where(f"reach between 0 and {FAR}").agg(F.max("reach"), F.min("need")).first()
    most, fewest = most or 0, fewest or LEAST
    near = f"filter(slice(l, i + 2, {most}), y -> y.at - x.at <= {most} and y.v != x.v)" if most > 0 else "filter(l, y -> false)"
    keys = f"array_distinct(flatten(transform(l, (x, i) -> transform({near}, y -> struct(xxhash64(x.v, y.v, y.at - x.at) as key, cast(y.at - x.at as int) as gap)))))"
    keyed = stand.where(F.col("common") >= fewest).select("class_id", "n", "reach", F.explode(F.expr(keys)).alias("k")).select("class_id", "n", "reach", "k.key", "k.gap")
    # Each side keeps what it needs: the shorter one no gaps beyond its reach.
    short = keyed.where(f"gap <= reach and reach <= {FAR}")
    ends = (F.least("x.class_id", "y.class_id").alias("a"), F.greatest("x.class_id", "y.class_id").alias("b"))
    less = "struct(x.n, x.class_id) < struct(y.n, y.class_id)"
    dense = short.alias("x").join(keyed.alias("y"), "key").where(less).select(*ends)
    placed = stand.select("class_id", "n", "common", "need", "reach", F.explode(F.expr("array_distinct(transform(l, x -> struct(x.df as df, x.v as v)))")).alias("x")).select("class_id", "n", "common", "need", "reach", "x.df", "x.v")
    by = Window.partitionBy("class_id")
    sparse = placed.where(F.col("reach") > FAR).withColumn("place", F.row_number().over(by.orderBy("df", "v"))).where("place <= common - need + 1")
    return few.unionAll(dense).unionAll(sparse.alias("x").join(placed.alias("y"), "v").where(less).select(*ends)).distinct()


def match(media: DataFrame, render=None, share: float = SHARE, errors: float = ERRORS) -> DataFrame:
    """media_id, n_prints, class_id (least media_id of equal prints), n_links, best_class, best_offset, best_errors.

    Links are other classes that `linked` finds; best_* is the link of fewest errors, then least id, null without one.
    Recordings without prints are classes of their own, as are null ids; repeated rows are one class; an empty table gives no rows.
    """
    prints = materialise(fingerprint(media, render), "prints")
    key = F.md5(F.to_json(F.struct("prints")).cast("binary"))
    keyed = prints.withColumn("print_key", F.when(F.size("prints") > 0, key).otherwise(F.concat(F.lit("empty "), F.coalesce(F.col("media_id").cast("string"), F.lit("")))))
    classes = materialise(keyed.groupBy("print_key").agg(F.min("media_id").alias("class_id"), F.first("prints").alias("prints")), "classes")
    pairs = materialise(candidates(classes, share), "pairs")
    of = classes.select("class_id", "prints")
    both = pairs.join(of.select(F.col("class_id").alias("a"), F.col("prints").alias("pa")), "a").join(of.select(F.col("class_id").alias("b"), F.col("prints").alias("pb")), "b")

    def run(batches):
        for d in batches:
            rows = []
            for a, b, x, y in zip(d["a"], d["b"], d["pa"], d["pb"], strict=True):
                x, y = np.asarray(x, np.int32).view(np.uint32), np.asarray(y, np.int32).view(np.uint32)
                if found := linked(x, y, share, errors):
                    shift, wrong = found
                    rows += [(a, b, shift, wrong), (b, a, -shift, wrong)]
            yield pd.DataFrame(rows, columns=["a", "other", "shift", "wrong"])

    kind = dict(media.dtypes)["media_id"]
    links = both.mapInPandas(run, f"a {kind}, other {kind}, shift int, wrong double")
    best = materialise(links.groupBy("a").agg(F.count("*").alias("n_links"), F.min(F.struct("wrong", "other", "shift")).alias("best")), "best")
    named = materialise(classes.join(best, classes["class_id"] == best["a"], "left").select("print_key", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "best"), "named")
    return keyed.join(named, "print_key").select("media_id", F.size("prints").alias("n_prints"), "class_id", "n_links", F.col("best.other").alias("best_class"), F.col("best.shift").alias("best_offset"), F.round("best.wrong", 6).alias("best_errors"))


def melody(values, note: int = 512) -> np.ndarray:
    """Renders numbers as a tune: each sounds for `note` samples at a pitch that rises with it (a semitone for each hundredth)."""
    v = np.nan_to_num(np.array([np.nan if x is None else x for x in values], float))
    hertz = 440 * 2 ** (np.clip(np.round(v * 100), -22, 22) / 12)
    phase = 2 * np.pi * np.cumsum(np.repeat(hertz, note)) / RATE
    return np.sin(phase) * 0.5
