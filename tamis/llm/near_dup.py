"""Near-duplicate groups: MinHash bands, signature verification, full sets, and star components.

1. Each text becomes its set of distinct word shingles; a digest of the set finds equal sets, of which only one goes on.
2. ``bands * rows`` universal hash minima are cut into bands; sets that agree on a band share a bucket.
3. Inside a bucket, signatures are compared; pairs that agree on enough minima join clusters (a spanning forest of them is
   emitted, never all pairs).
4. Inside a cluster the full sets are compared, exactly; again a spanning forest of the true links is emitted.
5. Components of the true links are the groups.

Buckets and clusters of more than a block's members are never brought together in one task.  They are split into blocks by a
hash; each block is first compared with itself and with one common block, which is linear in the members.  Then only the
members that are not yet in the group's largest component are compared with all blocks, so no link is lost.  A bucket with very many
such members, as a passage that unlike texts share makes it, is dealt anew by the rarest shingles of its members' full sets: of two
sets at the limit, each has a common shingle among its ``n - ceil(n * percent / 100) + 1`` first ones in any one order, so both meet
there for certain.  What a bucket's size decides is the way to a link, never whether it is found.

With ``bands = 32`` and ``rows = 4``, a pair of similarity 0.8 shares no bucket with probability 5e-8, and fails the test of
signatures (80 of 128 minima, where 102 are expected) with probability below 1e-6, whatever the sizes of its buckets.

Null texts and texts without words have empty sets: they link to nothing, and each is its own component.  Rows with one id count as
one document; a row without an id links to nothing, has no component and is kept.  Texts of any length are taken whole; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tamis.llm.batches import releasing, slices, small_batches
from tamis.llm.components import components
from tamis.llm.shingles import minima, mix64, shingle_sets
from tamis.shared import col, discard, materialise, unused

BLOCK = 256
BLOCK_SHINGLES = 1 << 17
#: Up to so many rows of two numbers are broadcast; beyond, the join is shuffled.
MOST_BROADCAST = 1_000_000
#: Groups with over so many blocks of members outside the largest component are dealt into smaller ones.
CROWDED = 8
WAYS, PLACES, DEPTH = 6, 4, 3
#: Shingles are counted in 2 ** RARITY_BITS bins, by their leading bits.
RARITY_BITS = 20


# -- kernels ------------------------------------------------------------------


def features(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sig`` of ``doc_id, text``; the last three are null for empty sets."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.encode() if t else None for t in part.column("text").to_pylist()]
            values, offsets = shingle_sets(texts, width)
            mins = minima(values, offsets, bands * rows, seed)
            keys = np.zeros((len(texts), bands), dtype=np.uint64)
            for k in range(rows):
                keys = mix64(keys + mins[:, k::rows].view(np.uint32) + np.uint64(0x9E3779B97F4A7C15))
            keys = mix64(keys + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
            sigs = mins.astype(np.uint8)
            full = offsets[1:] > offsets[:-1]
            digest = [
                hashlib.blake2b(values[lo:hi].tobytes(), digest_size=16).digest() if hi > lo else None
                for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_shingles": pa.array(np.diff(offsets)),
                    "digest": pa.array(digest, pa.binary()),
                    "bands": pa.array([k if f else None for k, f in zip(keys.tolist(), full, strict=True)], pa.list_(pa.int64())),
                    "sig": pa.array([s.tobytes() if f else None for s, f in zip(sigs, full, strict=True)], pa.binary()),
                }
            )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sig binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with its last column, ``text``, as sorted distinct ``shingles``."""
    carried = docs.columns[:-1]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, offsets = shingle_sets([t.encode() if t else None for t in part.column("text").to_pylist()], width)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), lists], names=[*carried, "shingles"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields[:-1], StructField("shingles", ArrayType(LongType()))]))


def _lists(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The values of a batch's ``shingles``, and where each row's begin and end in them."""
    lists = part.column("shingles")
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy()[at[0] : at[-1]], at - at[0]


def _bins(values: np.ndarray) -> np.ndarray:
    return values.view(np.uint64) >> np.uint64(64 - RARITY_BITS)


def rarity(sets: DataFrame) -> np.ndarray:
    """How many of all ``shingles`` fall into each bin."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, dtype=np.int64)
        for part in slices(batches):
            np.add.at(counts, _bins(_lists(part)[0]), 1)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bin", "n"])

    found = sets.select("shingles").mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    out[found.column("bin").to_numpy()] = found.column("n").to_numpy()
    return out


def rarest_shingles(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """``rep, component, grp`` for the first shingles of each of the ``rep, component, shingles``, rarest bins first.

    Two sets with 100 * intersection >= ``percent`` * union share one of them: at least ``n * percent / 100`` of either set are common, so
    the first common shingle has no more than the rest before it.  Shingles alone in their bin are alone, and left out.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, at = _lists(part)
            often = counts[_bins(values)]
            firsts = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                first = lo + np.lexsort((values[lo:hi], often[lo:hi]))[: hi - lo + percent * (lo - hi) // 100 + 1]
                firsts.append(first[often[first] > 1])
            rows = pa.array(np.repeat(np.arange(len(firsts)), [len(f) for f in firsts]))
            names = [part.column(c).take(rows) for c in ("rep", "component")]
            yield pa.RecordBatch.from_arrays([*names, pa.array(values[np.concatenate(firsts)])], names=["rep", "component", "grp"])

    return sets.mapInArrow(run, "rep bigint, component bigint, grp bigint")


def forest(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the least member of its component, of a symmetric boolean matrix."""
    order = np.argsort(ids, kind="stable")
    linked = linked[np.ix_(order, order)]
    np.fill_diagonal(linked, True)
    label = np.arange(len(ids))
    while True:
        new = np.where(linked, label[None, :], len(ids)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    names = ids[order]
    return names[moved], names[label[moved]]


def similar_signatures(sigs: np.ndarray, least: int) -> np.ndarray:
    """Which rows agree on at least ``least`` places."""
    agree = np.zeros((len(sigs), len(sigs)), dtype=np.uint16)
    for column in np.ascontiguousarray(sigs.T):
        agree += column[:, None] == column[None, :]
    return agree >= least


def similar_sets(sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Which sets have 100 * intersection >= ``percent`` * union, counted exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[which]
    owner, which = owner[keep], place[which[keep]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    both = np.zeros((n, n))
    for lo in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(which, [lo, lo + columns])
        held = np.zeros((n, columns), dtype=np.float32)
        held[owner[a:b], which[a:b] - lo] = 1
        both += held @ held.T
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by their first column: a table and the groups' bounds in it."""
    held: list[pa.RecordBatch] = []
    for batch in slices(batches, most_rows=2 * BLOCK):
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() == keys[0]:
            if not len(cuts):
                held.append(batch)
                continue
            held.append(batch.slice(0, cuts[0]))
            batch, cuts = batch.slice(cuts[0]), cuts[1:] - cuts[0]
        if held:
            yield _bounded(held)
        if len(cuts):
            yield _bounded([batch.slice(0, cuts[-1])])
            batch = batch.slice(cuts[-1])
        held = [batch]
    if held:
        yield _bounded(held)


def _bounded(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    whole = pa.Table.from_batches(parts).combine_chunks()
    keys = whole.column(0).to_numpy()
    return whole, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def link_signatures(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(g, rep, sig)`` sorted by ``g`` to forests of the pairs that agree on ``least`` places."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, bounds in _groups(batches):
            ids = whole.column("rep").to_numpy()
            sigs = np.frombuffer(b"".join(whole.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            alike = (sigs[two] == sigs[two + 1]).sum(axis=1) >= least
            found = [(ids[two[alike]], ids[two[alike] + 1])]
            for lo, hi in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2], strict=True):
                found.append(forest(similar_signatures(sigs[lo:hi], least), ids[lo:hi]))
            yield _edges(*map(np.concatenate, zip(*found, strict=True)))

    return run


def link_sets(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(g, rep, shingles)`` sorted by ``g`` to forests of the pairs of that similarity."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, bounds in _groups(batches):
            ids = whole.column("rep").to_numpy()
            lists = whole.column("shingles").chunk(0) if whole.num_rows else None
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    sets = [values[at[i] : at[i + 1]] for i in range(lo, hi)]
                    yield _edges(*forest(similar_sets(sets, percent), ids[lo:hi]))

    return run


# -- groups in blocks -----------------------------------------------------------


def _block(parts: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "rep"), F.col(parts)).cast("int")


def _linked(placed: DataFrame, kernel: Callable) -> DataFrame:
    """Distinct edges that a kernel finds in rows with a group number ``g`` in front."""
    sorted_ = placed.repartition("g").sortWithinPartitions("g")
    return materialise(sorted_.mapInArrow(kernel, "a bigint, b bigint").distinct(), "links")


def link_groups(
    members: DataFrame, payload: str, kernel: Callable, narrow: Callable | None = None, level: int = 0, depth: int = DEPTH
) -> DataFrame:
    """Components of what ``kernel`` links inside the groups: ``node, component`` of all linked nodes.

    ``members`` has ``grp, parts, rep`` and the payload; a group has ``parts`` blocks.  The frame is read several times,
    so it should be a written one.  ``narrow`` deals crowded groups into smaller ones, up to ``depth`` times; the links that it keeps
    together are found.  :func:`by_rare_shingles` keeps all that count, :func:`by_further_minima` most.
    """
    one = members.where("parts = 1").select(F.xxhash64("grp").alias("g"), "rep", payload)
    split = members.where("parts > 1").withColumn("block", _block("parts"))
    to = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("block"))
    first = split.withColumn("to", F.explode(to)).select(F.xxhash64("grp", "to").alias("g"), "rep", payload)
    edges = _linked(one.unionByName(first), kernel)
    found = components(edges)
    if split.isEmpty():
        discard(edges)
        return found

    # members outside their group's largest component, against all of the group
    named = split.join(found, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialise(named.select("grp", "parts", "block", "rep", "component"), "block-members")
    counts = named.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("grp").agg(F.max(F.struct("n", F.col("component").alias("major"))).alias("top"), F.sum("n").alias("all"))
    rest = largest.select("grp", "top.major", F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("rest_parts")).where("rest_parts > 0")
    crowded = rest.where(F.col("rest_parts") > CROWDED).select("grp") if narrow else None
    if narrow:
        rest = rest.where(F.col("rest_parts") <= CROWDED)
    apart = named.join(rest, "grp")
    rest_block = _block("rest_parts")
    minor = apart.where("component <> major").select(
        "grp", "rep", rest_block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j")
    )
    every = apart.select("grp", "rep", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)).alias("i"), F.col("block").alias("j"))
    pairs = minor.unionByName(every.select("grp", "rep", "i", "j")).distinct()
    loads = split.select("grp", "rep", payload)
    second = pairs.join(loads, ["grp", "rep"]).select(F.xxhash64("grp", "i", "j").alias("g"), "rep", payload)
    more = _linked(second, kernel)
    deeper = None
    if narrow and not crowded.isEmpty():
        open_ = named.join(crowded, "grp").select("grp", "rep", "component").join(loads, ["grp", "rep"])
        cut = narrow(open_, level)
        deeper = link_groups(cut, payload, kernel, narrow if level + 1 < depth else None, level + 1, depth)
        discard(cut)
    # what is known already is a set of stars, so few rounds are left
    new = more if deeper is None else more.unionByName(deeper.select(F.col("node").alias("a"), F.col("component").alias("b")))
    out = found if new.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
    discard(edges, more, named, deeper, *([] if out is found else [found]))
    return out


def _sized(keys: DataFrame) -> DataFrame:
    """``grp, parts`` of the groups of more than one component in ``grp, component``: others have nothing to find."""
    sizes = keys.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return sizes.where("n > 1 AND lo <> hi").select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))


def by_rare_shingles(texts: DataFrame, width: int, percent: int) -> Callable[[DataFrame, int], DataFrame]:
    """A function from ``members`` (``grp, rep, component, sig``) to groups ``grp, parts, rep, sig`` by rare shingles of their ``texts``.

    All pairs of members at the limit meet in a group, also those of different buckets.  Rare are shingles of the bins that the
    members' shingles fill least, so a passage makes a group only of texts with little else.
    """

    def dealt(members: DataFrame, level: int) -> DataFrame:
        reps = materialise(members.select("rep", "component", "sig").distinct(), "open-members")
        chosen = texts.join(reps.select("rep", "component").distinct(), F.col("doc_id") == F.col("rep")).select("rep", "component", "text")
        sets = materialise(full_sets(chosen, width), "open-sets")
        keys = materialise(rarest_shingles(sets, rarity(sets), percent), "rare-shingles")
        out = keys.join(_sized(keys), "grp").join(reps.select("rep", "sig"), "rep").select("grp", "parts", "rep", "sig")
        out = materialise(out, "dealt-groups")
        discard(reps, sets, keys)
        return out

    return dealt


def by_further_minima(members: DataFrame, level: int) -> DataFrame:
    """Groups ``grp, parts, rep, sig`` that ``members`` (``grp, rep, component, sig``) make by more places of their signatures.

    For members without texts at hand: a pair may be parted in all ways, so the operator deals by :func:`by_rare_shingles`.  Each
    member goes ``WAYS`` times to the group of those that agree with it on ``PLACES`` places, which a hash of the old group's key chooses.
    """

    def key(way: int) -> Column:
        places = [F.pmod(F.xxhash64(F.lit(level), F.lit(way), F.lit(k), "grp"), F.length("sig")).cast("int") + 1 for k in range(PLACES)]
        return F.xxhash64("grp", F.lit(way), *[F.substr("sig", at, F.lit(1)) for at in places])

    keys = members.select("rep", "component", "sig", F.explode(F.array(*[key(w) for w in range(WAYS)])).alias("grp"))
    return materialise(keys.join(_sized(keys), "grp").select("grp", "parts", "rep", "sig"), "cut-groups")


# -- operator -------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
    least_agreeing: int | None = None,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the least id of the document's group; ``kept`` marks that document.  Ids are whole numbers.
    """
    with small_batches(docs.sparkSession):  # every job of it runs in here
        return _near_duplicates(docs, width, percent, bands, rows, least_agreeing, seed, id_col, text_col)


def _near_duplicates(
    docs: DataFrame, width: int, percent: int, bands: int, rows: int, least_agreeing: int | None, seed: int, id_col: str, text_col: str
) -> DataFrame:
    if least_agreeing is None:  # five standard deviations below what a pair at the limit is expected to share
        p, n = percent / 100, bands * rows
        least_agreeing = max(1, int(n * p - 5 * (n * p * (1 - p)) ** 0.5))
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    known = materialise(features(texts, width, bands, rows, seed), "features")

    # one document for each distinct set
    reps = known.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    reps = materialise(reps, "distinct-sets")

    # buckets of two and more
    keys = reps.select("rep", F.explode("bands").alias("grp"))
    counts = keys.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")
    held = keys.join(counts.select("grp", parts), "grp")
    members = materialise(held.join(reps.select("rep", "sig"), "rep").select("grp", "parts", "rep", "sig"), "buckets")
    clusters = link_groups(members, "sig", link_signatures(least_agreeing), by_rare_shingles(texts, width, percent), depth=1)
    discard(members)

    # full sets of the clusters' members
    sized = clusters.join(reps.select("rep", "n"), F.col("node") == F.col("rep")).select("component", "rep", "n")
    totals = sized.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("parts")
    listed = materialise(sized.join(totals, "component").select(F.col("component").alias("grp"), parts, "rep"), "clusters")
    small = listed.count() <= MOST_BROADCAST
    chosen = texts.join(F.broadcast(listed) if small else listed, F.col("doc_id") == F.col("rep"))
    chosen = chosen.select("grp", "parts", "rep", "text")

    full = materialise(full_sets(chosen, width), "sets")
    groups = link_groups(full, "shingles", link_sets(percent))
    discard(full, listed, clusters)

    named = reps.select("digest", "rep").join(groups, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("digest").alias("of"), F.coalesce("component", "rep").alias("component"))
    out = known.select("doc_id", "n_shingles", "digest").join(named, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    out = materialise(out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept")), "near-duplicates")
    discard(known, reps, groups)
    return out


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose group has a document of a lesser id; columns stay as they are."""
    gone = unused("gone", docs)
    dropped = near_duplicates(docs, id_col=id_col, **options).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    # ids of 8 bytes each are broadcast behind a count of them; beyond it the join is sorted
    dropped = F.broadcast(dropped) if dropped.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else dropped.hint("merge")
    return docs.join(dropped, col(id_col).cast("long") == F.col(gone), "left_anti")
