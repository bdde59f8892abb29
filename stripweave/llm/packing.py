"""Best-fit packing with several permitted sequence lengths.

Rows are dealt by a hash into blocks of bounded size, and each block is packed on its own: longest pieces first, each into the
open bin it fills best. If none has room, a bin is opened with the length whose price per packed token is least, judged by how
the pieces still to come would fill it. At the end each bin shrinks to the shortest permitted length that holds its contents. What lies in
bins that are not full enough is packed again, together with that of the other blocks, until one block holds it: a few pieces of each block, so rounds
are few. A round that leaves more than LEFT of the pieces it was given is the last: pieces that fill no bin among 20,000 others are of sizes that fit together badly
(such as all just over half of the longest length), and another mix of them would not fill theirs either; their bins stay as full as a block made them. The sequences themselves are the pieces' tokens in their bins' order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripweave.llm.common import written

LENGTHS = (512, 1024, 2048, 4096)
BLOCK_ROWS = 20_000
#: Bins filled to this share are final; the rest of several blocks is packed again together.
FULL = 0.97
#: A round that leaves more than this share of its pieces in bins that are not full is the last one.
LEFT = 0.8
#: A sequence of length n is priced n + n * n / QUADRATIC: a fixed share for each place, and attention.
QUADRATIC = 16_384


def price(length: int) -> float:
    return length + length * length / QUADRATIC


def pack_sizes(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in the bin, length it was opened with and final length for each size (1 to the largest length)."""
    lengths = sorted(lengths)
    sizes = np.asarray(sizes, np.int64)
    if len(sizes) and (sizes.min() < 1 or sizes.max() > lengths[-1]):
        raise ValueError("a size that no permitted length holds")
    order = np.argsort(-sizes, kind="stable")
    left = np.bincount(sizes, minlength=lengths[-1] + 1).tolist()
    waiting = sum(1 << s for s, n in enumerate(left) if n)  # the sizes still to come, as bits
    room: dict[int, list[int]] = {}
    rooms = 0  # the rooms of open bins, as bits
    used: list[int] = []
    opened: list[int] = []
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)

    def filled(size: int, length: int) -> int:
        """What a new bin of this length would hold: the largest size that fits, again and again."""
        free, taken = length - size, {}
        mask = waiting
        while free and (fits := mask & ((1 << free + 1) - 1)):
            s = fits.bit_length() - 1
            have = left[s] - taken.get(s, 0)
            n = min(have, free // s)
            taken[s] = taken.get(s, 0) + n
            free -= n * s
            if n == have:
                mask &= ~(1 << s)
        return length - free

    for k in order.tolist():
        s = int(sizes[k])
        left[s] -= 1
        if not left[s]:
            waiting &= ~(1 << s)
        fits = rooms >> s
        if fits:
            r = (fits & -fits).bit_length() - 1 + s
            same = room[r]
            b = same.pop()
            if not same:
                rooms &= ~(1 << r)
        else:
            r = min((c for c in lengths if c >= s), key=lambda c: price(c) / filled(s, c))
            b = len(used)
            used.append(0)
            opened.append(r)
        bins[k], places[k] = b, used[b]
        used[b] += s
        if r > s:
            room.setdefault(r - s, []).append(b)
            rooms |= 1 << r - s
    final = np.asarray(lengths)[np.searchsorted(lengths, used)] if used else np.empty(0, np.int64)
    return bins, places, np.asarray(opened, np.int64)[bins], final[bins]


def split_documents(docs: DataFrame, size: Column, longest: int) -> DataFrame:
    """``doc_id, text_hash, piece, start, n_tokens``: documents over the longest permitted length are cut into pieces of that length and a rest; ``text_hash`` tells the
    texts of one id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), size.cast("long").alias("_n"))
    pieces = rows.select("doc_id", "text_hash", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / longest))).alias("piece"))
    start = F.col("piece") * longest
    return pieces.select("doc_id", "text_hash", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("_n") - start).alias("n_tokens"))


END = "<|end|>"
#: Stands for a null id in joins.
NO_ID = -(1 << 63)


def word_tokens(text: Column) -> Column:
    """A text's words by white space, and one end token; null counts as empty."""
    return F.concat(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)), F.array(F.lit(END)))


def token_count(text: Column) -> Column:
    """How many tokens ``word_tokens`` gives."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)) + 1


SCHEMA = "doc_id long, text_hash long, piece int, start long, n_tokens long, bin_id long, place long, opened_length int, bin_length int"


def _dealt(pieces: DataFrame, blocks: int) -> DataFrame:
    """``pieces`` with ``_block``. Equal pieces are counted first and dealt one after the other from the block of their hash on, so that the
    result does not depend on how the input is laid out, and no row repeated many times gathers in one block."""
    same = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("_same"))
    rows = same.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_same") - 1)))
    return rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_hash", "piece") + F.col("_k"), F.lit(blocks))).drop("_same", "_k")


def pack_documents(docs: DataFrame, *, lengths: Sequence[int] = LENGTHS, size: Column | None = None, block_rows: int = BLOCK_ROWS, full: float = FULL) -> DataFrame:
    """One row per piece: ``doc_id, text_hash, piece, start, n_tokens, bin_id, place, opened_length, bin_length``.

    ``size`` is a document's tokens (its words and an end token, if not given), ``place`` the piece's offset in its bin. Null and empty texts take one token.
    Repeated rows and ids are packed as they come, pieces of equal size by id. An empty table gives no rows; other columns are ignored.
    """
    lengths = tuple(sorted(set(lengths)))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    left = written(split_documents(docs, token_count(F.col("text")) if size is None else size, lengths[-1]), "pieces")
    done, rounds = [], 0
    while True:
        blocks = max(1, -(-left.count() // block_rows))

        first = rounds << 56

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["n_tokens", "doc_id", "text_hash", "piece"], ascending=[False, True, True, True], ignore_index=True)
            bins, places, opened, final = pack_sizes(rows["n_tokens"], lengths)
            return rows.assign(bin_id=first + rows["_block"].astype("int64") * (1 << 24) + bins, place=places, opened_length=opened.astype("int32"), bin_length=final.astype("int32"))[names]

        packed = written(_dealt(left, blocks).groupBy("_block").applyInPandas(run, SCHEMA), "packed")
        if blocks == 1:
            break
        used = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("_used"))
        packed = written(packed.join(used, "bin_id").withColumn("_full", F.col("_used") >= full * F.col("bin_length")).select(*names, "_full"), "packed")
        rest = written(packed.filter(~F.col("_full")).select(*left.columns), "pieces")
        if rest.count() > LEFT * left.count():  # nothing to gain from more rounds
            packed = packed.drop("_full")
            break
        done.append(packed.filter("_full").drop("_full"))
        left, rounds = rest, rounds + 1
    for d in done:
        packed = packed.unionByName(d)
    return packed


def sequences(docs: DataFrame, packed: DataFrame, tokens: Column | None = None) -> DataFrame:
    """One row per bin: ``bin_id, bin_length, n_tokens, doc_ids, starts, tokens``: the pieces' documents, the offset of each in the sequence, and the tokens
    (those of ``tokens``, an array over ``docs``, or words with an end token). What ``n_tokens`` leaves of ``bin_length`` is padding."""
    docs = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text_hash": F.xxhash64("text")})
    body = F.coalesce(F.col("text"), F.lit("")) if tokens is None else tokens
    # Repeated rows have one body: it is read once and joined to all their pieces. Words travel as text, which is far smaller than arrays of them.
    rows = docs.select("_id", "text_hash", body.alias("_body")).dropDuplicates(["_id", "text_hash"])
    own = packed.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    every = F.col("_body") if tokens is not None else word_tokens(F.col("_body"))
    piece = F.slice(every, F.col("start").cast("int") + 1, F.col("n_tokens").cast("int"))
    piece = piece if tokens is not None else F.array_join(piece, " ")
    whole = own.join(rows, ["_id", "text_hash"]).select("bin_id", "bin_length", "place", "doc_id", "n_tokens", piece.alias("_piece"))
    found = whole.groupBy("bin_id", "bin_length").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("place", "doc_id", "_piece"))).alias("_all"))
    pieces = F.col("_all._piece")
    joined = F.flatten(pieces) if tokens is not None else F.split(F.array_join(pieces, " "), " ")
    return found.select("bin_id", "bin_length", "n_tokens", F.col("_all.doc_id").alias("doc_ids"), F.col("_all.place").alias("starts"), joined.alias("tokens"))


def bin_report(packed: DataFrame) -> DataFrame:
    """One row per bin length: bins, tokens, and the share of places filled."""
    bins = packed.groupBy("bin_id").agg(F.max("bin_length").alias("bin_length"), F.sum("n_tokens").alias("n"))
    return bins.groupBy("bin_length").agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"), (F.sum("n") / F.sum("bin_length")).alias("filled"))
