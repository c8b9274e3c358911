"""Splitting oversized items at natural boundaries, with overlap between consecutive pieces.

One bounded-quantifier regular expression consumes the text from left to right; its alternatives are
ordered by the strength of the boundary they end at (blank line, line, sentence, clause, word), and a plain
run of characters is the last one. Each match is the new text of one piece; array functions then put the
overlap, found by looking back from the cut, in front of it. All of it stays in the JVM.

Defined results: a null text gives null, an empty one an empty array, a text within the limit one piece.
Pieces are numbered from 0 in the order of the text; lengths are Unicode code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1024, 256

#: Boundaries from strong to weak: what a piece may end with. A piece keeps its trailing white space.
_ENDS = [r"(?<=\n\s{0,8}\n)", r"(?<=\n)", r"(?<=[.!?…。！？۔।॥][\"'”’»)\]]{0,2}\s)|(?<=[。！？])", r"(?<=[;:,、，；：]\s)", r"(?<=\s)"]


def boundary_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The pattern whose matches, end to end, are the text; none but the last is shorter than ``overlap``.

    The first piece may use the whole limit, later ones what the overlap leaves. A boundary counts only
    in the last two thirds of a piece, so that a heading doesn't end one early; runs of characters
    without any boundary are cut at the limit.
    """
    def run(most: int) -> str:
        least = max(1, overlap, most // 3)
        ends = "|".join(rf".{{{least},{most}}}(?:{e})" for e in _ENDS)
        return rf".{{1,{most}}}\z|{ends}|.{{1,{most}}}"

    later = limit - overlap
    return rf"(?s)\A(?:{run(limit)})|(?:{run(later)})"


#: Starts gathered in one array before it is put to the others.
_GATHERED = 256


def _starts(cores: Column) -> Column:
    """Where each of consecutive texts begins: running sums of lengths.

    An array is copied as it grows, so starts are gathered in short ones; a text's pieces cost about the same each.
    """
    kind = "struct<total:int,done:array<array<int>>,last:array<int>>"

    def step(acc: Column, c: Column) -> Column:
        full = F.size(acc["last"]) >= _GATHERED
        done = F.when(full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"])
        last = F.concat(F.when(full, F.array().cast("array<int>")).otherwise(acc["last"]), F.array(acc["total"]))
        return F.struct((acc["total"] + F.length(c)).alias("total"), done.alias("done"), last.alias("last")).cast(kind)

    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("last")).cast(kind)
    return F.aggregate(cores, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]))))


def split_items(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, pieces) of each row; pieces is an array of struct(piece_no, n_pieces, start_pos, end_pos, piece).

    A piece after the first starts with the last ``overlap`` characters of the one before, or with fewer
    of them, from the first word among them on; where they hold no white space, with all of them. Positions
    are code point offsets. No shuffle; work and memory follow the length of each text. Null keys are kept.
    """
    if not 0 <= overlap <= limit // 3:
        raise ValueError("overlap must lie between 0 and a third of the limit")
    t = F.col("_s_text")
    whole = F.filter(F.array(t), lambda x: x != "")
    cores = F.when(F.length(t) <= limit, whole).otherwise(F.regexp_extract_all(t, F.lit(boundary_pattern(limit, overlap)), F.lit(0)))
    d = df.select(F.col(key).alias("_s_key"), F.col(text).alias("_s_text")).select("_s_key", cores.alias("_s_cores"))
    # Starts of the new texts as running sums of their lengths; the text before each; how many there are.
    # No lambda refers to a column: the optimizer could put a column's expression in its place, and run it per element.
    starts = _starts(F.col("_s_cores"))
    before = F.concat(F.array(F.lit("")), "_s_cores")
    parts = F.arrays_zip(F.col("_s_cores").alias("c"), starts.alias("s"), F.slice(before, F.lit(1), F.size("_s_cores")).alias("b"), F.array_repeat(F.size("_s_cores"), F.size("_s_cores")).alias("n"))
    d = d.select("_s_key", parts.alias("_s_parts"))

    def backed(z: Column) -> Column:
        back = F.regexp_replace(F.right(z["b"], F.lit(overlap)), r"(?s)\A.*?\s+(?=\S)", "") if overlap else F.lit("")
        return F.struct(z["c"].alias("c"), z["s"].alias("s"), back.alias("b"), z["n"].alias("n"))

    def piece(z: Column, i: Column) -> Column:
        return F.struct(i.cast("int").alias("piece_no"), z["n"].alias("n_pieces"), (z["s"] - F.length(z["b"])).alias("start_pos"), (z["s"] + F.length(z["c"])).alias("end_pos"), F.concat(z["b"], z["c"]).alias("piece"))

    return d.select(F.col("_s_key").alias(key), F.transform(F.transform("_s_parts", backed), piece).alias("pieces"))
