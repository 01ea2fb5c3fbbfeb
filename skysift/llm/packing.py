"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.storage import materialize
from skysift.llm.textkit import chunks, runs, utf8_buffers

CAPACITY = 4096
#: Id that closes each document.
CLOSE = 1
#: Pieces that one population packs; its islands; children between migrations; rounds of children; individuals on an island.
CELL, ISLANDS, CHILDREN, EPOCHS, POPULATION = 8192, 3, 60, 4, 8
#: Loose items of which pairs are tried in exchange for one item of a bin.
MOST_PAIRED = 48

# ---- tokens ------------------------------------------------------------------------------------------------------------------------------------

#: Classes of bytes for texts of Latin-1 characters, lower-cased, as the vocabulary's pre-tokenizer splits them: runs of letters, single numbers, runs of
#: other marks, blanks dropped. A two-byte character has one class. Texts with other characters (before lower-casing), apostrophes (contractions split) or <| go to the tokenizer whole.
BLANK, LETTER, NUMBER, OTHER, FOREIGN = range(5)


def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    one = np.full(256, OTHER, np.uint8)
    one[[9, 10, 11, 12, 13, 32]] = BLANK
    one[ord("a") : ord("z") + 1] = LETTER
    one[ord("0") : ord("9") + 1] = NUMBER
    one[ord("'")] = FOREIGN
    one[0xC4:] = FOREIGN
    two = np.full((2, 64), OTHER, np.uint8)
    for code in range(0x80, 0x100):
        c = chr(code)
        kind = LETTER if c.isalpha() else NUMBER if code in (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE) else BLANK if code in (0x85, 0xA0) else OTHER
        two[code >> 6 & 1, code & 63] = kind
    return one, two


ONE, TWO = _class_tables()
#: Bytes of text that are split at a time, and whose words are looked up together.
CHUNK, LOOKED_UP = 1 << 19, 4 << 20
#: Words whose ids a worker keeps: about 30 bytes each.
MOST_WORDS = 200_000


class _Words:
    """Ids of texts, by way of kept ids of pre-tokens: the tokenizer splits words apart before it merges, so each word's ids stand by themselves."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        end = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(end.values()) + 1, bool)
        self.closes[[i for w, i in end.items() if w.endswith("</w>")]] = True
        #: Kept words, their ids one after the other, and how many each has.
        self.known, self.flat, self.sizes = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def fill(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words one after the other, and how many each has; tokenized as one text with blanks between: a word's ids end with one that closes
        a word."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 2000):
            part = words.slice(at, 2000)
            data, starts = utf8_buffers(part)
            text = np.insert(data, starts[1:-1], ord(" ")).tobytes().decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                each = [self.whole(w.decode()) for w in part.to_pylist()]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            flat.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(flat), np.concatenate(sizes)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different words: ids, and where in them each word's begin and how many it has. New words are kept while there is room."""
        index = pc.index_in(words, value_set=self.known)
        missing = words.filter(index.is_null())
        flat, sizes = self.fill(missing)
        flat, sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        at = pc.fill_null(index, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(missing))
        if len(missing) and len(self.known) < MOST_WORDS:
            self.known, self.flat, self.sizes = pa.concat_arrays([self.known, missing]), flat, sizes
        return flat, (np.cumsum(sizes) - sizes)[at], sizes[at]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        data, starts = utf8_buffers(pc.utf8_lower(pc.fill_null(texts, "")))
        for a, b in chunks(starts, LOOKED_UP):
            # split in small pieces; the words of all are looked up together, as most come again
            split = [(a + lo, *self._split(texts.slice(a + lo, hi - lo), data[starts[a + lo] : starts[a + hi]], starts[a + lo : a + hi + 1] - starts[a + lo])) for lo, hi in chunks(starts[a : b + 1], CHUNK)]
            words = pa.concat_arrays([tokens.dictionary for _, tokens, _, _ in split]).dictionary_encode()
            code, done = words.indices.to_numpy(), 0
            flat, begin, sizes = self.lookup(words.dictionary)
            for first, tokens, bounds, odd in split:
                index = code[done : done + len(tokens.dictionary)][tokens.indices.to_numpy()]
                done += len(tokens.dictionary)
                count = sizes[index]
                ends = np.concatenate([[0], np.cumsum(count)])
                out = flat[np.repeat(begin[index] - ends[:-1], count) + np.arange(int(ends[-1]))]
                bounds = ends[bounds]
                for k, whole in enumerate(odd.tolist()):
                    yield self.whole(texts[first + k].as_py()) if whole else out[bounds[k] : bounds[k + 1]]

    def _split(self, texts: pa.Array, data: np.ndarray, starts: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """Pre-tokens of all texts, each text's first (one more for the end), and whether a text goes to the tokenizer whole."""
        kind = ONE[data]
        lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
        kind[lead] = kind[lead + 1] = TWO[data[lead] & 1, data[lead + 1] & 63]
        strange = kind == FOREIGN
        if len(data) > 1:
            strange[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        odd = np.add.reduceat(np.append(strange, False).astype(np.int64), np.minimum(starts[:-1], len(data)))
        odd[np.diff(starts) == 0] = 0
        # judged on the bytes as they came too: lower-casing makes a plain i of U+0130, where the tokenizer makes two characters
        raw, at = utf8_buffers(texts)
        foreign = np.concatenate([[0], np.cumsum(raw >= 0xC4, dtype=np.int32)])
        odd |= foreign[at[1:]] > foreign[at[:-1]]
        if odd.any():
            kind[np.repeat(odd > 0, np.diff(starts))] = BLANK
        kept = kind != BLANK
        begin = kept.copy()
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        edges = starts[:-1][starts[:-1] < len(data)]
        begin[edges] = kept[edges]
        tail = lead + 1
        begin[tail] = False
        packed = data[kept]
        place = np.cumsum(kept)
        at = np.flatnonzero(begin)
        offsets = np.append(place[at] - 1, len(packed)).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))]).dictionary_encode()
        return tokens, np.searchsorted(at, starts), odd > 0


@lru_cache(1)
def _words(path: str) -> _Words:
    return _Words(path)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        close = np.array([CLOSE], "<u4").tobytes()
        for batch in batches:
            found = words.ids(batch.column(2))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                owner, number, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(islice(found, part.num_rows)):
                    raw = ids.astype("<u4").tobytes() + close
                    for i, a in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[a : a + 4 * capacity]
                        owner.append(k)
                        number.append(i)
                        start.append(a // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


# ---- grouping genetic algorithm ------------------------------------------------------------------------------------------------------------------

#: A solution is a list of bins; a bin is a tuple of item numbers.
Solution = list[tuple[int, ...]]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Items, largest first, each into the fullest bin with room: bins by room, and a bit set of the rooms in use."""
    bins = bins if bins is not None else []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for b, members in enumerate(bins):
        room = capacity - sum(sizes[i] for i in members)
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        fit = rooms >> sizes[i]
        if fit:
            room = sizes[i] + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        room -= sizes[i]
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    return bins


def fitness(s: Solution, sizes: list[int], capacity: int) -> float:
    """Mean squared fill of the bins (Falkenauer): fewer and fuller bins are better."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in s) / max(len(s), 1)


def exchange(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Bins give one or two items for one or two loose ones that fill them better (Martello and Toth's dominance); what is loose then, which is smaller
    and easier to place. Every exchange makes a bin fuller, so it ends."""
    free = sorted((sizes[i], i) for i in loose)
    for b in rng.sample(range(len(bins)), len(bins)):
        members = bins[b]
        room = capacity - sum(sizes[i] for i in members)
        if not room or not free:
            continue
        best: tuple[int, list[int], list[tuple[int, int]]] = (0, [], [])
        outs = [[i] for i in members] + ([[i, j] for x, i in enumerate(members) for j in members[:x]] if len(members) <= 12 else [])
        for out in outs:
            given = sum(sizes[i] for i in out)
            k = bisect_right(free, (given + room, len(sizes))) - 1
            if k >= 0 and free[k][0] - given > best[0]:
                best = (free[k][0] - given, out, [free[k]])
        if best[0] < room:
            few = free if len(free) <= MOST_PAIRED else rng.sample(free, MOST_PAIRED)
            few = sorted(few)
            for i in members:
                lo, hi, most = 0, len(few) - 1, sizes[i] + room
                while lo < hi:
                    total = few[lo][0] + few[hi][0]
                    if total > most:
                        hi -= 1
                        continue
                    if total - sizes[i] > best[0]:
                        best = (total - sizes[i], [i], [few[lo], few[hi]])
                    lo += 1
        if best[0]:
            gone = set(best[1])
            bins[b] = [i for i in members if i not in gone] + [i for _, i in best[2]]
            for x in best[2]:
                free.remove(x)
            for i in best[1]:
                insort(free, (sizes[i], i))
    return [i for _, i in free]


def crossover(a: Solution, b: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """Whole well-filled bins of b go into a; bins of a that share an item with them are emptied, their other items are exchanged into fuller places and
    best-fitted."""
    ranked = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    top = ranked[: max(1, len(ranked) // 2)]
    injected = rng.sample(top, max(1, len(top) // rng.choice((2, 4, 8))))
    taken = {i for x in injected for i in x}
    kept, loose = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    bins = [*map(list, injected), *kept]
    loose = exchange(bins, loose, sizes, capacity, rng)
    return [tuple(x) for x in best_fit(loose, sizes, capacity, bins)]


def mutate(s: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """The emptiest bins and a few others are emptied, exchanged and best-fitted again."""
    ranked = sorted(s, key=lambda x: sum(sizes[i] for i in x))
    n = max(1, len(s) // rng.choice((20, 50, 100)))
    out = ranked[:n] + rng.sample(ranked[n:], min(n, len(ranked) - n))
    gone = set(map(id, out))
    bins = [list(x) for x in ranked if id(x) not in gone]
    loose = exchange(bins, [i for x in out for i in x], sizes, capacity, rng)
    return [tuple(x) for x in best_fit(loose, sizes, capacity, bins)]


def least_bins(sizes: list[int], capacity: int, enough: int | None = None) -> int:
    """No packing has fewer bins (Martello and Toth's second bound): for each k, items over capacity - k have bins of their own, those over half have one
    each, and the rest from k on need what room these leave, or more bins. A sum that proves `enough` bins needed is not searched further."""
    if not sizes:
        return 0
    if enough is not None and -(-sum(sizes) // capacity) >= enough:
        return -(-sum(sizes) // capacity)
    x = np.sort(np.array(sizes, np.int64))
    upto = np.concatenate([[0], np.cumsum(x)])
    best = -(-int(upto[-1]) // capacity)
    half = int(np.searchsorted(x, capacity // 2, "right"))
    for k in np.unique(x[: max(half, 1)]).tolist():
        big, low = int(np.searchsorted(x, capacity - k, "right")), int(np.searchsorted(x, k, "left"))
        big, low = max(big, half), min(low, half)
        middle = big - half
        rest = int(upto[half] - upto[low]) - (middle * capacity - int(upto[big] - upto[half]))
        best = max(best, len(x) - big + middle + max(0, -(-rest // capacity)))
    return best


def evolve(population: list[Solution], sizes: list[int], capacity: int, children: int, rng: random.Random) -> list[Solution]:
    """Children of tournament, crossover and mutation, one after another; a child takes the worst one's place if it is fitter and new. The fittest come
    first. Ends when the bound is met."""
    bound = least_bins(sizes, capacity, min(map(len, population)))
    fit = lambda s: (-len(s), fitness(s, sizes, capacity))
    ranked = sorted(((fit(s), k, s) for k, s in enumerate(population)), reverse=True)
    for child in range(children):
        if len(ranked[0][2]) <= bound:
            break
        a, b = (max(rng.sample(ranked, min(2, len(ranked))))[2] for _ in range(2))
        made = crossover(a, b, sizes, capacity, rng) if a is not b else mutate(a, sizes, capacity, rng)
        if rng.random() < 0.5:
            made = mutate(made, sizes, capacity, rng)
        f = fit(made)
        if f > ranked[-1][0] and all(f != r[0] for r in ranked) or len(ranked) < 2:
            ranked = sorted([*ranked, (f, len(population) + child, made)], reverse=True)[: max(len(population), 2)]
    return [s for _, _, s in ranked]


def seeds(sizes: list[int], capacity: int, population: int, rng: random.Random) -> list[Solution]:
    """Best fit of the items in decreasing order, and of halves of them taken at random one after the other."""
    out = [[tuple(x) for x in best_fit(list(range(len(sizes))), sizes, capacity)]]
    while len(out) < population and len(out[0]) > least_bins(sizes, capacity, len(out[0])):
        order = list(range(len(sizes)))
        rng.shuffle(order)
        half = best_fit(order[: len(order) // 2], sizes, capacity)
        out.append([tuple(x) for x in best_fit(order[len(order) // 2 :], sizes, capacity, half)])
    return out


def _encode(s: Solution, n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for b, x in enumerate(s):
        out[list(x)] = b
    return out.tobytes()


def _decode(raw: bytes) -> Solution:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(np.frombuffer(raw, np.int32).tolist()):
        bins.setdefault(b, []).append(i)
    return [tuple(x) for x in bins.values()]


ISLAND_SCHEMA = "cell long, island int, lengths binary, population array<binary>, done boolean"


SCHEMA = pa.schema([("cell", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("population", pa.list_(pa.binary())), ("done", pa.bool_())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by (cell, uid): one row per cell, its lengths in that order."""
    for t in runs(batches, ["cell"]):
        yield pa.RecordBatch.from_arrays([t.column("cell")[:1].combine_chunks(), pa.array([t.column("length").to_numpy().astype(np.int32).tobytes()], pa.binary())], names=["cell", "lengths"])


def _begin(capacity: int, islands: int):
    """Of pieces sorted by (cell, uid): a cell's best fit if it meets the bound, done and on one island; else an empty population for each island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gather(batches):
            for r in batch.to_pylist():
                sizes = np.frombuffer(r["lengths"], np.int32).tolist()
                best = best_fit(list(range(len(sizes))), sizes, capacity)
                done = len(best) <= least_bins(sizes, capacity, len(best))
                yield pa.RecordBatch.from_pylist([r | {"island": i, "population": [_encode(best, len(sizes))] if done else [], "done": done} for i in range(1 if done else islands)], SCHEMA)

    return run


def _settle(capacity: int, population: int, children: int, seed: int):
    """An epoch on each island: rows (cell, island, lengths, population, done); an empty population is seeded first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.frombuffer(r["lengths"], np.int32).tolist()
                rng = random.Random(f"{seed}:{r['cell']}:{r['island']}:{len(r['population'])}")
                if not r["done"]:
                    people = [_decode(x) for x in r["population"]] or seeds(sizes, capacity, population, rng)
                    people = evolve(people, sizes, capacity, children, rng)
                    r["population"] = [_encode(s, len(sizes)) for s in people[:population]]
                    r["done"] = len(people[0]) <= least_bins(sizes, capacity, len(people[0]))
                yield pa.RecordBatch.from_pylist([r], SCHEMA)

    return run


def migrate(islands: DataFrame, n_islands: int) -> DataFrame:
    """Each island's best goes to the next island of its cell and takes the place of the worst there. Cells that are done keep what they have."""
    elite = islands.select("cell", ((F.col("island") + 1) % n_islands).alias("island"), F.get("population", F.lit(0)).alias("elite"), F.col("done").alias("elite_done"))
    x = islands.join(elite, ["cell", "island"], "left")
    better = F.concat(F.slice("population", 1, F.greatest(F.size("population") - 1, F.lit(1))), F.array("elite"))
    return x.select(
        "cell", "island", "lengths", F.when(F.col("done"), F.col("population")).when(F.col("elite_done"), F.array("elite")).otherwise(better).alias("population"), (F.col("done") | F.coalesce("elite_done", F.lit(False))).alias("done")
    )


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by (cell, uid), behind one row of uid -1 with the cell's packing: the bin, its fill, and the offset of each piece."""
    for t in runs(batches, ["cell"]):
        bins = np.frombuffer(t.column("packing")[0].as_py(), np.int32).astype(np.int64)
        t = t.slice(1)
        length = t.column("length").to_numpy()
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        base = np.maximum.accumulate(np.where(first, ends - length[order], 0))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - length[order] - base
        fill = np.bincount(bins, length)[bins].astype(np.int64)
        yield pa.RecordBatch.from_arrays([t.column("uid").combine_chunks(), pa.array((t.column("cell").to_numpy() << 24) + bins), pa.array(offset), pa.array(fill)], names=["uid", "sequence_id", "offset", "fill"])


def _pack_cells(items: DataFrame, cell_items: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """items (uid, length) -> (uid, sequence_id, offset, fill): cells by hash, islands of each evolve and migrate, the best packing is laid out."""
    n = max(1, -(-items.count() // cell_items))
    parts = min(n, 4096)
    cells = materialize(items.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(n))).repartition(parts, "cell").sortWithinPartitions("cell", "uid"), "cells")
    ordered = cells.repartition(parts, "cell").sortWithinPartitions("cell", "uid")
    state = materialize(ordered.mapInArrow(_begin(capacity, islands), ISLAND_SCHEMA), "islands")
    for epoch in range(epochs):
        if not state.where("not done").limit(1).count():
            break
        if epoch:
            state = materialize(migrate(state, islands), "migrated")
        state = materialize(state.repartition(parts * islands, "cell", "island").mapInArrow(_settle(capacity, POPULATION, CHILDREN, seed + epoch), ISLAND_SCHEMA), "islands")
    best = state.mapInArrow(_count_bins, "cell long, island int, n_bins long, packing binary").groupBy("cell").agg(F.min_by("packing", F.struct("n_bins", "island")).alias("packing"))
    none = cells.select("cell", "uid", "length", F.lit(None).cast("binary").alias("packing"))
    laid = none.unionByName(best.select("cell", F.lit(-1).cast("long").alias("uid"), F.lit(0).cast("long").alias("length"), "packing")).repartition(parts, "cell").sortWithinPartitions("cell", "uid")
    return laid.mapInArrow(_place, "uid long, sequence_id long, offset long, fill long")


def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            raw = r["population"][0]
            yield pa.RecordBatch.from_arrays([pa.array([r["cell"]]), pa.array([r["island"]], pa.int32()), pa.array([int(np.frombuffer(raw, np.int32).max(initial=-1)) + 1]), pa.array([raw], pa.binary())], names=["cell", "island", "n_bins", "packing"])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, cell_items: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 6) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A document is its ids and the closing id 1 (null and empty texts: that one id); only one longer than `capacity` is cut. Cells of about
    `cell_items` pieces are packed by the genetic algorithm; sequences that a cell leaves under seven eighths full are opened, and their pieces packed
    again together, until few are left. A cell whose best-fit seed already meets the lower bound is optimal and is not evolved. Repeated rows, and rows
    of equal or null doc_id, are packed each. Pieces of a sequence lie without gaps from offset 0. An empty table gives an empty one; extra columns,
    whatever their names, are not read."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row_id long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer_path, capacity), schema), "pieces")
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    items = pieces.select("uid", "length")
    done: DataFrame | None = None
    low = capacity * 7 // 8
    for round_ in range(4):
        laid = materialize(_pack_cells(items, cell_items, capacity, islands, epochs, seed + round_), "laid").withColumn("sequence_id", F.col("sequence_id") * 4 + round_)
        loose = laid.where(F.col("fill") < low).join(items, "uid").select("uid", "length")
        open_bins = laid.where(F.col("fill") < low).select("sequence_id").distinct().limit(2).count()
        full = laid if open_bins < 2 or round_ == 3 else laid.where(F.col("fill") >= low)
        done = full if done is None else done.unionByName(full)
        if open_bins < 2:
            break
        items = materialize(loose, "loose")
    return pieces.join(done, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
