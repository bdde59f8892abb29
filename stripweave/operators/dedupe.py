"""Duplicates and matches by hash, vector, box and text; joins reduce the pairs before any fold in order."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.functions import geometry as G
from stripweave.functions import vectors as V
from stripweave.operators.folds import ordered_fold
from stripweave.session import ship, stored


def exact_hash_dedupe(pages: DataFrame, by: Sequence[str] = ("chapter",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Of each chapter's pages with one hash the first."""
    at = F.row_number().over(Window.partitionBy(*by, "hash").orderBy(*order))
    return pages.withColumn("_at", at).filter(F.col("_at") == 1).drop("_at")


def hash_pairs(pages: DataFrame, most_bits: int = 3, bits: int = 64) -> DataFrame:
    """``chapter, a, b`` (a before b) of pages whose hashes differ in at most so many bits: exact. Of ``most_bits`` + 2 bands at least two are equal in such a pair, so pages
    meet by pairs of bands: a stretch that many pages have in common, such as a blank one, does not bring them all together. Pages with
    equal hashes meet through the first of them only; the fold in order needs no more."""
    bands = most_bits + 2
    size = -(-bits // bands)
    first = exact_hash_dedupe(pages)
    part = [F.shiftrightunsigned("hash", size * k).bitwiseAND((1 << size) - 1) for k in range(bands)]
    keys = F.array(*(F.struct(F.lit(i * bands + j).alias("band"), (F.shiftleft(part[i], size) + part[j]).alias("key")) for i in range(bands) for j in range(i)))
    rows = first.select("chapter", "seq", "hash", F.explode(keys).alias("_b")).select("chapter", "seq", "hash", "_b.band", "_b.key")
    x, y = (rows.select("chapter", "band", "key", *(F.col(c).alias(c + s) for c in ("seq", "hash"))) for s in "xy")
    met = x.join(y, ["chapter", "band", "key"]).filter((F.col("seqx") < F.col("seqy")) & (V.hash_distance(F.col("hashx"), F.col("hashy")) <= most_bits))
    return met.select("chapter", F.col("seqx").alias("a"), F.col("seqy").alias("b")).distinct()


def greedy_keep(rows: DataFrame, pairs: DataFrame, key: str, order: Sequence[str], ident: str) -> DataFrame:
    """``key, ident, kept``: each key's rows in order, kept unless near to an earlier kept one. ``pairs`` has ``key, a, b``: the ids of two rows near
    to each other, a before b in the order. ``ident`` is unique within its key; only keys with pairs are folded, all other rows are kept."""
    near = stored(pairs.groupBy(key, F.col("b").alias(ident)).agg(F.sort_array(F.collect_set("a")).alias("near")))  # read twice
    every = rows.select(*dict.fromkeys([key, ident, *order])).join(near, [key, ident], "left")
    linked = near.select(key).distinct()
    folded = _greedy(every.join(linked, key, "left_semi"), key, order, ident, dict(rows.dtypes)[ident])
    return every.select(key, ident).join(folded, [key, ident], "left").select(key, ident, F.coalesce("kept", F.lit(True)).alias("kept"))


def _greedy(rows: DataFrame, key: str, order: Sequence[str], ids: str, kind: str) -> DataFrame:
    """Rows in order with ``near``, the earlier rows each one is near to: a row is kept unless one of these was."""

    def step(kept: set, row: object) -> list[tuple]:
        mine = getattr(row, ids)
        if any(n in kept for n in (row.near if row.near is not None else ())):
            return [(getattr(row, key), mine, False)]
        kept.add(mine)
        return [(getattr(row, key), mine, True)]

    key_kind = dict(rows.dtypes)[key]
    return ordered_fold(rows, key, list(order), lambda _: set(), step, lambda k, s: [], f"{key} {key_kind}, {ids} {kind}, kept boolean")


def near_hash_dedupe(pages: DataFrame, most_bits: int = 3) -> DataFrame:
    """``chapter, seq, kept``: pages in order, dropped if near to an earlier kept one. Copies of an earlier page follow its fate: it is kept, or near to a kept one."""
    out = greedy_keep(exact_hash_dedupe(pages), hash_pairs(pages, most_bits), "chapter", ["seq"], "seq")
    return pages.select("chapter", "seq").join(out, ["chapter", "seq"], "left").select("chapter", "seq", F.coalesce("kept", F.lit(False)).alias("kept"))


def box_nms(boxes: DataFrame, by: str, most: float = 0.48) -> DataFrame:
    """``by, box_id, kept``: boxes by falling confidence, dropped if they overlap a kept one by more than so much."""
    return _keep_best(boxes, by, most, None)


def text_block_dedupe(blocks: DataFrame, by: str, likeness: float = 0.86, overlap: float = 0.18) -> DataFrame:
    """``by, box_id, kept``: blocks by falling confidence, dropped if a kept one has nearly their words and overlaps them."""
    return _keep_best(blocks, by, overlap, likeness)


class KeptBoxes:
    """Boxes kept so far, each in one cell of a grid that is as wide and high as boxes of about its size. Two boxes that share more than ``most`` (0 to 1) of their union
    differ by less than that factor in width and in height, so a box meets only those of like size in the cells around it."""

    def __init__(self, most: float) -> None:
        self.most, self.base = most, min(8.0, max(1.5, 1 / max(most, 0.01))) * (1 + 1e-9)
        self.reach = math.ceil(math.log(1 / most) / math.log(self.base)) if most > 0 else math.inf
        self.cells: dict[tuple, list[tuple]] = {}
        self.sizes: set[tuple[int, int]] = set()
        self.like: dict[tuple, list[tuple]] = {}

    def _size(self, w: float, h: float) -> tuple[int, int]:
        return math.floor(math.log(w) / math.log(self.base)), math.floor(math.log(h) / math.log(self.base))

    def _around(self, size: tuple[int, int]) -> list[tuple]:
        """The sizes that boxes near to one of this size may have, likest first, with their cells' width and height."""
        if size not in self.like:
            far = lambda s: max(abs(s[0] - size[0]), abs(s[1] - size[1]))
            self.like[size] = [(*s, self.base ** (s[0] + 1), self.base ** (s[1] + 1)) for s in sorted(self.sizes, key=far) if far(s) <= self.reach]
        return self.like[size]

    def near(self, x: float, y: float, w: float, h: float) -> Iterator[object]:
        """What was put in with each of the kept boxes that share more than ``most`` with this one."""
        right, bottom, area = x + w, y + h, w * h
        for i, j, wide, high in self._around(self._size(w, h)):
            columns = range(int(x // wide) - 1, int(right // wide) + 1)
            for cy in range(int(y // high) - 1, int(bottom // high) + 1):
                for cx in columns:
                    for kx, ky, kr, kb, size, what in self.cells.get((i, j, cx, cy), ()):
                        if kx < right and x < kr and ky < bottom and y < kb:
                            shared = (min(right, kr) - max(x, kx)) * (min(bottom, kb) - max(y, ky))
                            if shared / max(1.0, area + size - shared) > self.most:
                                yield what

    def put(self, x: float, y: float, w: float, h: float, what: object) -> None:
        size = self._size(w, h)
        if size not in self.sizes:
            self.sizes.add(size)
            self.like.clear()
        cell = (*size, int(x // self.base ** (size[0] + 1)), int(y // self.base ** (size[1] + 1)))
        self.cells.setdefault(cell, []).append((x, y, x + w, y + h, w * h, what))


def _keep_best(boxes: DataFrame, by: str, most: float, likeness: float | None) -> DataFrame:
    """One pass over each key's boxes, best first. A box is compared with the kept ones near it and not with every box that it overlaps: on a page of any number of boxes these are no more than
    its area holds apart. Boxes without a size or place are near to none."""
    words = F.lit(None).cast("array<string>") if likeness is None else G.tokens(F.col("text"))
    rows = boxes.select(by, "box_id", *(F.col(c).cast("double").alias(c) for c in "xywh"), (-F.col("confidence")).alias("less"), words.alias("words"))

    def step(kept: KeptBoxes, row: object) -> list[tuple]:
        box = row.x, row.y, row.w, row.h
        if not all(map(math.isfinite, box)) or row.w <= 0 or row.h <= 0:
            return [(getattr(row, by), row.box_id, True)]
        mine = frozenset(row.words) if row.words is not None else frozenset()
        alike = lambda other: likeness is None or (mine and other and len(mine & other) / len(mine | other) > likeness)
        if any(alike(other) for other in kept.near(*box)):
            return [(getattr(row, by), row.box_id, False)]
        kept.put(*box, mine)
        return [(getattr(row, by), row.box_id, True)]

    kinds = dict(boxes.dtypes)
    found = ordered_fold(rows, by, ["less", "y", "x", "box_id"], lambda _: KeptBoxes(most), step, lambda k, s: [], f"{by} {kinds[by]}, box_id {kinds['box_id']}, kept boolean")
    return found.unionByName(boxes.filter(F.col(by).isNull()).select(by, "box_id", F.lit(True).alias("kept")))


#: Signatures of a block, and pivots to which their angles are known.
SIGNATURES_EACH, PIVOTS = 1024, 6


def _signature_blocks(rows: DataFrame, by: str, ident: str, name: str) -> DataFrame:
    """``by, {name}``: the signatures that have a direction, in blocks of about SIGNATURES_EACH of one key."""
    usable = F.col("signature").isNotNull() & F.exists("signature", lambda x: x != 0) & ~F.exists("signature", lambda x: x.isNull())
    rows = rows.filter(F.col(by).isNotNull() & usable).select(by, F.col(ident).alias("id"), F.col("signature").cast("array<double>").alias("v"))
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / SIGNATURES_EACH).alias("_n"))
    rows = rows.join(sizes, by).withColumn("_block", F.pmod(F.xxhash64("id", "v"), F.col("_n")))
    return rows.groupBy(by, "_block").agg(F.collect_list(F.struct("id", "v")).alias(name)).drop("_block")


def _unit(side: pa.StructArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the signatures their places and the unit vectors."""
    lengths = np.array([len(v) for v in side.field("v")])
    out, flat = {}, side.field("v").flatten().to_numpy(zero_copy_only=False)
    starts = np.append(0, np.cumsum(lengths))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        m = flat[starts[at][:, None] + np.arange(n)]
        out[n] = at, m / np.sqrt((m * m).sum(1))[:, None]
    return out


def nearest_within(asked: np.ndarray, known: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs of unit vectors at a cosine distance of at most ``most``: their places, distances, and how many pairs were compared.

    Angles obey the triangle inequality: where the angles of two vectors to one pivot differ by more than the limit, so do they, and
    the pair is skipped. Pivots are known vectors far from each other."""
    angle = lambda x, y: np.arccos(np.clip(x @ y.T, -1, 1))
    picks, far = [0], np.full(len(known), np.inf)
    for _ in range(min(PIVOTS, len(known)) - 1):
        far = np.minimum(far, angle(known, known[picks[-1:]])[:, 0])
        picks.append(int(far.argmax()))
    limit = float(np.arccos(max(-1.0, 1 - most))) + 1e-7
    to_known, to_asked = angle(known, known[picks]), angle(asked, known[picks])
    order = np.argsort(to_known[:, 0], kind="stable")
    first = np.searchsorted(to_known[order, 0], to_asked[:, 0] - limit)
    last = np.searchsorted(to_known[order, 0], to_asked[:, 0] + limit, "right")
    left = np.repeat(np.arange(len(asked)), last - first)
    right = order[np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)]).astype(np.int64)]
    for p in range(1, len(picks)):
        near = np.abs(to_asked[left, p] - to_known[right, p]) <= limit
        left, right = left[near], right[near]
    d = 1 - np.einsum("ij,ij->i", asked[left], known[right])
    hit = d <= most
    return left[hit], right[hit], d[hit], len(left)


def signature_candidates(signatures: DataFrame, profiles: DataFrame, by: str, most: float = 0.18) -> DataFrame:
    """``by, face, profile_id, d, compared``: within each key and pair of blocks the nearest profile of each face, if it is near enough;
    ``compared`` are the pairs of which the distance was worked out, told with the first row of a pair of blocks."""
    kinds = dict(signatures.dtypes) | {"profile_id": dict(profiles.dtypes)["profile_id"]}
    schema = f"{by} {kinds[by]}, face {kinds['face']}, profile_id {kinds['profile_id']}, d double, compared long"
    met = _signature_blocks(signatures, by, "face", "asked").join(_signature_blocks(profiles, by, "profile_id", "known"), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked, known = batch["asked"][i].values, batch["known"][i].values
                theirs, best, compared = _unit(known), {}, 0
                for n, (at, m) in _unit(asked).items():
                    if n in theirs:
                        left, right, d, tried = nearest_within(m, theirs[n][1], most)
                        compared += tried
                        names = known.field("id").take(pa.array(theirs[n][0][right])).to_pylist()
                        for a, name, x in zip(at[left].tolist(), names, d.tolist(), strict=True):
                            best[a] = min(best.get(a, (x, name)), (x, name))
                places = sorted(best)
                columns = [
                    pa.array([batch[by][i].as_py()] * len(places), batch[by].type), asked.field("id").take(pa.array(places, pa.int64())),
                    pa.array([best[p][1] for p in places], known.field("id").type), pa.array([best[p][0] for p in places], pa.float64()),
                    pa.array([compared if not j else 0 for j in range(len(places))], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    ship(signatures.sparkSession)
    return met.mapInArrow(run, schema)


def signature_match(signatures: DataFrame, profiles: DataFrame, by: str, most: float = 0.18) -> DataFrame:
    """``by, face, profile_id, confidence``: the profile with the nearest signature within its series, where near enough. Faces and known
    signatures meet in blocks, so a frequent series is many tasks' work."""
    met = signature_candidates(signatures, profiles, by, most)
    best = met.groupBy(by, "face").agg(F.min(F.struct("d", "profile_id")).alias("_b"))
    return best.select(by, "face", F.col("_b.profile_id").alias("profile_id"), (1 - F.col("_b.d") / most).alias("confidence"))


def signature_novelty(signatures: DataFrame, by: str, order: Sequence[str], *, least: float = 0.04, last: int = 16) -> DataFrame:
    """``by, face``: signatures that were new when they came, of each key the last ones: a vector is added only if it is further than ``least`` from all held ones."""
    def step(held: list, row: object) -> None:
        v = np.asarray(row.signature, float)
        norm = np.sqrt((v * v).sum())
        far = [1 - float(v @ u) / (norm * m) if norm * m > 0 and len(u) == len(v) else V.FAR for _, u, m in held]
        if len(v) and norm > 0 and (not far or min(far) > least):
            held.append((row.face, v, norm))
            del held[:-last]

    kind = dict(signatures.dtypes)
    return ordered_fold(signatures.select(by, "face", "signature", *(o for o in order if o != "face")), by, list(order), lambda _: [], step, lambda k, held: [(k, f) for f, _, _ in held], f"{by} {kind[by]}, face {kind['face']}")


def nearest_face(blocks: DataFrame, faces: DataFrame, by: str, most: float = 0.42) -> DataFrame:
    """``by, block, face, score``: for each block the face of its panel with the least distance over the diagonal; faces below weigh a little more, large ones less. None above the limit."""
    met = blocks.select(by, "block", "width", "height", *(F.col(c).alias("b_" + c) for c in "xywh")).join(faces.select(by, "face", *(F.col(c).alias("f_" + c) for c in "xywh")), by)
    (bx, by_), (fx, fy) = G.bbox_center(G.box("b_")), G.bbox_center(G.box("f_"))
    distance = F.hypot(bx - fx, by_ - fy) * F.when(fy > by_, 1.12).otherwise(1.0)
    bonus = F.least(F.lit(0.18), F.col("f_w") * F.col("f_h") / F.greatest(F.lit(1), F.col("width") * F.col("height")) * 6)
    score = distance / F.greatest(F.lit(1.0), F.hypot(F.col("width").cast("double"), F.col("height").cast("double"))) - bonus
    best = met.groupBy(by, "block").agg(F.min(F.struct(F.round(score, 12).alias("score"), "face")).alias("_b"))
    return best.filter(F.col("_b.score") <= most).select(by, "block", F.col("_b.face").alias("face"), F.col("_b.score").alias("score"))


def top_faces(faces: DataFrame, by: str, page_area: Column, n: int = 8, least: float = 0.002) -> DataFrame:
    """The largest faces of each panel that cover at least the given share of it."""
    area = F.col("w") * F.col("h")
    at = F.row_number().over(Window.partitionBy(by).orderBy(area.desc(), "face"))
    return faces.filter(area >= page_area * least).withColumn("rank", at).filter(F.col("rank") <= n)


def _page_edges(rows: DataFrame, most: int) -> DataFrame:
    """One row for each page with one before it: ``strip_id, seq, own, above`` (their heights), ``head`` (its first rows) and ``tail`` (the
    last rows of the one before). Each edge row is shuffled once as head and once as tail; both sides are grouped by the keys they
    meet by, so nothing else is."""
    own = F.struct(F.col("y").cast("int").alias("at"), "vec", "edge_vec")
    head = rows.filter(F.col("y") < most).groupBy("strip_id", "seq").agg(F.max("height").cast("int").alias("own"), F.collect_list(own).alias("head"))
    up = F.struct((F.col("height") - F.col("y")).cast("int").alias("at"), "vec", "edge_vec")
    tail = rows.filter(F.col("y") >= F.col("height") - most).withColumn("seq", F.col("seq") + 1)
    tail = tail.groupBy("strip_id", "seq").agg(F.max("height").cast("int").alias("above"), F.collect_list(up).alias("tail"))
    return head.join(tail, ["strip_id", "seq"])


def _matrices(side: pa.StructArray, width: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and edge vectors of rows by their place from ``first`` on; rows that are missing are not numbers."""
    at = side.field("at").to_numpy(zero_copy_only=False) - first
    out = []
    for name in ("vec", "edge_vec"):
        m = np.full((int(at.max()) + 1, width), np.nan)
        m[at] = side.field(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        out.append(m)
    return out[0], out[1]


def _overlaps(rows: DataFrame, most: int, least: int, step: int) -> DataFrame:
    """``strip_id, seq, k, d, de, head_dev, tail_dev`` for each page, the one before it and each overlap k (the most that both have, and down
    by ``step``): mean differences of the k pairs of rows that then lie on each other, of pixels and of edges, and the deviation of
    each side. Overlaps with a missing row, and pages of unequal widths, have none."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"strip_id {kinds['strip_id']}, seq {kinds['seq']}, k int, d double, de double, head_dev double, tail_dev double"

    def deviations(m: np.ndarray) -> np.ndarray:
        n = np.arange(1, len(m) + 1) * m.shape[1]
        s, q = np.cumsum(m.sum(1)), np.cumsum((m * m).sum(1))
        return np.sqrt(np.maximum(0, q / n - (s / n) ** 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (own, above) in enumerate(zip(batch["own"].to_pylist(), batch["above"].to_pylist(), strict=True)):
                top, head, tail = min(most, own, above), batch["head"][i].values, batch["tail"][i].values
                widths = {len(v) for side in (head, tail) for name in ("vec", "edge_vec") for v in side.field(name)}
                if top < least or len(widths) != 1 or not min(widths):
                    continue
                h, he = _matrices(head, min(widths), 0)
                t, te = _matrices(tail, min(widths), 1)  # row u - 1 is u rows above the border
                head_dev, tail_dev = deviations(h), deviations(t)
                for k in range(top, least - 1, -step):
                    if k > len(h) or k > len(t):
                        continue
                    d = float(np.abs(h[:k] - t[k - 1 :: -1]).mean(1).mean())
                    if d == d:
                        at.append(i)
                        found.append((k, d, float(np.abs(he[:k] - te[k - 1 :: -1]).mean(1).mean()), head_dev[k - 1], tail_dev[k - 1]))
            columns = [pa.array([x[j] for x in found], pa.int32() if not j else pa.float64()) for j in range(5)]
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["strip_id"].take(places), batch["seq"].take(places), *columns], [c.split()[0] for c in schema.split(", ")])

    ship(rows.sparkSession)
    return _page_edges(rows, most).mapInArrow(run, schema)


def seam_overlaps(
    rows: DataFrame, *, most: int = 420, least: int = 24, step: int = 4, good: float = 0.94, fair: float = 0.9, flat: float = 8 / 255
) -> DataFrame:
    """``strip_id, seq, overlap, score`` for each page and the one before: for every overlap k the likeness of the last k rows and the first
    k, as .65 of pixels and .35 of edges; the first k (from the largest) that is good, else the best that is fair, else 0. Overlaps of
    which a side is flat (a deviation of less than ``flat``) are not looked at. ``rows`` has ``strip_id, seq, y, height, vec,
    edge_vec``, values from 0 to 1. A strip's pages meet two by two, as one row of packed edges."""
    score = _overlaps(rows, most, least, step).filter((F.col("head_dev") >= flat) & (F.col("tail_dev") >= flat))
    likeness = 0.65 * (1 - F.col("d")) + 0.35 * (1 - F.col("de"))
    score = score.select("strip_id", "seq", "k", F.round(likeness, 9).alias("s"))
    best = score.groupBy("strip_id", "seq").agg(F.max(F.when(F.col("s") >= good, F.struct("k", "s"))).alias("g"), F.max(F.struct("s", "k")).alias("f"))
    pages = rows.select("strip_id", "seq").distinct().filter(F.col("seq") > 0)
    best = pages.join(best, ["strip_id", "seq"], "left")
    some = F.when(F.col("f.s") >= fair, F.col("f.k"))
    return best.select("strip_id", "seq", F.coalesce("g.k", some, F.lit(0)).alias("overlap"), F.coalesce("g.s", "f.s", F.lit(0.0)).alias("score"))


def seam_first_fit(rows: DataFrame, *, most: int = 300, least: int = 30, step: int = 1, difference: float = 0.04) -> DataFrame:
    """``strip_id, seq, overlap``: the largest overlap at which the rows differ by no more than ``difference`` on average, else 0. ``rows``
    as for ``seam_overlaps``."""
    best = _overlaps(rows, most, least, step).filter(F.round("d", 12) <= difference).groupBy("strip_id", "seq").agg(F.max("k").alias("overlap"))
    return rows.select("strip_id", "seq").distinct().filter(F.col("seq") > 0).join(best, ["strip_id", "seq"], "left").na.fill(0, ["overlap"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def seam_correlations(rows: DataFrame, *, depth: int = 30, least_width: int = 10) -> DataFrame:
    """``strip_id, seq, seam``: how the last ``depth`` rows of each panel correlate with the first of the next one, over their common width; 0 where one side is flat or the
    common width is not over ``least_width``. Panels of fewer rows have none. ``rows`` has ``strip_id, seq, y, height, vec``."""
    deep = rows.filter(F.col("height") >= depth)
    tail = deep.filter(F.col("y") >= F.col("height") - depth).select("strip_id", "seq", (F.col("y") - F.col("height") + depth).alias("j"), F.col("vec").alias("tv"))
    head = deep.filter(F.col("y") < depth).select("strip_id", (F.col("seq") - 1).alias("seq"), F.col("y").alias("j"), F.col("vec").alias("hv"))
    met = tail.join(head, ["strip_id", "seq", "j"]).withColumn("_w", F.least(F.size("tv"), F.size("hv")))
    a, b = F.slice("tv", F.lit(1), F.col("_w")), F.slice("hv", F.lit(1), F.col("_w"))
    sums = met.select("strip_id", "seq", "_w", _sum(a).alias("a"), _sum(b).alias("b"), *(_sum(F.zip_with(x, y, lambda u, v: (u * v).cast("double"))).alias(n) for n, x, y in (("aa", a, a), ("bb", b, b), ("ab", a, b))))
    t = sums.groupBy("strip_id", "seq").agg(F.sum("_w").alias("n"), F.min("_w").alias("_w"), *(F.sum(c).alias(c) for c in ("a", "b", "aa", "bb", "ab")))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("aa") - F.col("a") * F.col("a") / F.col("n")) * F.greatest(F.lit(0.0), F.col("bb") - F.col("b") * F.col("b") / F.col("n")))
    seam = F.when((spread > 1e-6) & (F.col("_w") > least_width), (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / spread).otherwise(0.0)
    return t.select("strip_id", "seq", seam.alias("seam"))


def false_splits(panels: DataFrame, least: float = 0.96) -> DataFrame:
    """``strip_id, seq, merged``: adjacent panels whose seam correlates (``seam``, with the next one) are merged in pairs from the left, none twice."""
    order = Window.partitionBy("strip_id").orderBy("seq")
    hit = F.coalesce(F.col("seam") >= least, F.lit(False))
    rows = panels.withColumn("_hit", hit).withColumn("_run", F.sum((~F.col("_hit")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("strip_id", F.coalesce("_run", F.lit(0))).orderBy("seq"))
    rows = rows.withColumn("_first", F.col("_hit") & (place % 2 == 1))
    return rows.withColumn("merged", F.col("_first") | F.coalesce(F.lag("_first").over(order), F.lit(False))).select("strip_id", "seq", "merged")
