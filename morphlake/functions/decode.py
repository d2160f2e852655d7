"""Character labels to morphemes.

B opens a morpheme, E ends one, S is one, I goes on; what doesn't fit is repaired and flagged. `segments` is a
fold over each row's arrays (no shuffle), `segments_by_window` states the same with window functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphlake.functions.encode import chars, ints, label_parts, literal_map
from morphlake.schema import LABELS, MORPHEME_TYPES, MORPHEMES


def tag_columns(tags: Column, by_name: bool = False, labels: Mapping[str, int] = LABELS) -> Column:
    """Array of (prefix, type_id) for tag ids (or label names); unknown ones count as a single root."""
    parts = label_parts(labels)
    root = F.lit(MORPHEME_TYPES["ROOT"])
    if by_name:
        prefix, kind = (literal_map({name: parts[i][k] for name, i in labels.items()}) for k in (0, 1))
        look = lambda table, t: F.try_element_at(table, t)
    else:  # ids are few and small: constant arrays
        most = max(parts) + 1
        prefix = F.split(F.lit(",".join(parts.get(i, ("S", 0))[0] for i in range(most))), ",")
        kind = ints([parts.get(i, ("S", MORPHEME_TYPES["ROOT"]))[1] for i in range(most)])
        look = F.get
    return F.transform(tags, lambda t: F.struct(F.coalesce(look(prefix, t), F.lit("S")).alias("prefix"), F.coalesce(look(kind, t), root).alias("type_id")))


def segments(word: Column, tags: Column, confs: Column, repair: bool = True) -> Column:
    """struct(morphemes, repaired) of a word, its (prefix, type_id) tags and confidences.

    The shortest of the three decides the length; null gives null. A morpheme's type is that of its B, its
    confidence the mean over its characters; characters labelled padding or unknown vanish. With repair, I or
    E outside a morpheme stands alone, and a morpheme left open is closed; both set repaired, as does a B or S
    inside one. Without, I opens and E closes whatever type and confidences were there last.
    """
    n = F.least(F.char_length(word), F.size(tags), F.size(confs))
    # zipped, not indexed: the arrays may be expressions, and are evaluated once here
    tagged = F.zip_with(chars(word), tags, lambda c, t: F.struct(c.alias("c"), t["prefix"].alias("p"), t["type_id"].alias("t")))
    steps = F.slice(F.zip_with(tagged, confs, lambda x, f: F.struct(x["c"].alias("c"), x["p"].alias("p"), x["t"].alias("t"), f.cast("double").alias("f"))), F.lit(1), F.greatest(n, F.lit(0)))
    piece = lambda text, kind, conf: F.struct(text.alias("text"), kind.cast("int").alias("type_id"), conf.cast("double").alias("confidence"))
    state = lambda segs, cur, kind, s, k, err: F.struct(segs.alias("segs"), cur.alias("cur"), kind.alias("kind"), s.alias("s"), k.alias("k"), err.alias("err"))
    zero = state(F.array().cast(MORPHEMES), F.lit(""), F.lit(-1), F.lit(0.0), F.lit(0), F.lit(False))

    def step(a: Column, x: Column) -> Column:
        is_open, p = a["cur"] != "", x["p"]
        held = piece(a["cur"], a["kind"], a["s"] / F.greatest(a["k"], F.lit(1)))
        alone = piece(x["c"], x["t"], x["f"])
        grown = piece(F.concat(a["cur"], x["c"]), a["kind"], (a["s"] + x["f"]) / (a["k"] + 1))
        closed = lambda segs: F.when(is_open, F.concat(segs, F.array(held))).otherwise(segs)
        nothing = (F.lit(""), a["kind"])
        orphan = (p.isin("I", "E") & ~is_open) if repair else F.lit(False)
        return (
            F.when(orphan, state(F.concat(a["segs"], F.array(alone)), a["cur"], a["kind"], a["s"], a["k"], F.lit(True)))
            .when(p == "B", state(closed(a["segs"]), x["c"], x["t"], x["f"], F.lit(1), a["err"] | is_open))
            .when(p == "I", state(a["segs"], F.concat(a["cur"], x["c"]), a["kind"], a["s"] + x["f"], a["k"] + 1, a["err"]))
            .when(p == "E", state(F.concat(a["segs"], F.array(grown)), *nothing, F.lit(0.0), F.lit(0), a["err"]))
            .when(p == "S", state(F.concat(closed(a["segs"]), F.array(alone)), *nothing, a["s"], a["k"], a["err"] | is_open))
            .otherwise(a)
        )

    def finish(a: Column) -> Column:
        is_open = a["cur"] != ""
        last = F.array(piece(a["cur"], a["kind"], a["s"] / F.greatest(a["k"], F.lit(1))))
        return F.struct(F.when(is_open, F.concat(a["segs"], last)).otherwise(a["segs"]).alias("morphemes"), (a["err"] | (is_open & F.lit(repair))).alias("repaired"))

    return F.when(word.isNotNull() & tags.isNotNull() & confs.isNotNull(), F.aggregate(steps, zero, step, finish))


def word_confidence(word: Column, confs: Column) -> Column:
    """Mean over the positions of the word, dropped characters included; null where there is none."""
    own = F.slice(confs, F.lit(1), F.greatest(F.char_length(word), F.lit(0)))
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own))


def exact_round(x: Column, digits: int = 4) -> Column:
    """A double rounded by its exact value, halves to even, as promotion at a threshold expects; null for NaN.

    Spark's own rounding goes by the shortest decimal form, which takes 0.00045 for a half though the number is a
    little less. Here x is split into two parts of at most 27 bits, so that twice its multiple of the last digit is
    an exact sum, and the sign of its distance from the half is exact too. digits: 0 to 7.
    """
    if not 0 <= digits <= 7:
        raise ValueError(digits)
    unit = float(10**digits)
    a = F.abs(x)
    high = a * 134217729.0 - (a * 134217729.0 - a)  # 2**27 + 1
    k = F.floor(a * unit).cast("double")
    over = (high * (2 * unit) - (2 * k + 1)) + (a - high) * (2 * unit)
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(k % 2)
    near = F.when(a >= 2.0**52 / unit, a).otherwise((k + up) / unit)  # beyond, a double has no more digits
    return F.when(~F.isnan(x), F.when(x < 0, -near).otherwise(near))


def segments_by_window(rows: DataFrame, key: str) -> DataFrame:
    """key, seg, text, type_id, confidence, error of rows (key, pos, ch, prefix, type_id, conf), by windows."""
    w = Window.partitionBy(key).orderBy("pos")
    before = F.last(F.when(F.col("prefix").isin("B", "E", "S"), F.col("prefix")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("open", F.coalesce(before == "B", F.lit(False)))
    single = F.col("prefix").isin("I", "E") & ~F.col("open")
    marked = marked.withColumn("start", F.col("prefix").isin("B", "S") | single).withColumn("error", (F.col("prefix").isin("B", "S") & F.col("open")) | single)
    numbered = marked.withColumn("seg", F.sum(F.col("start").cast("int")).over(w)).where(F.col("prefix").isin("B", "I", "E", "S"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "")
    return numbered.groupBy(key, "seg").agg(text.alias("text"), F.min_by("type_id", "pos").alias("type_id"), F.avg("conf").alias("confidence"), F.bool_or("error").alias("error"))
