"""Best-fit packing of token sequences by bin completion on a length histogram."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_columns

#: Beyond these characters the library itself splits the whole text.
ODD = re.compile("[^\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-įı-ſ–—‘-”•…€]|<\\|")
#: The tokenizer's own split pattern, for the characters that ODD leaves.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\\sa-z0-9À-ÖØ-öø-ſ]+")


# Byte-level form: a printable byte is its Latin-1 character, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds(dict):
    """Pre-token to its ids as little-endian bytes; emptied when full.

    Pre-tokens go to the tokenizer's model directly, in the byte-level form that its
    own pre-tokenizer would give them."""

    def __init__(self, tokenizer, max_entries: int):
        super().__init__()
        self.tokenizer, self.max_entries = tokenizer, max_entries
        self.model = tokenizer.model

    def __missing__(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_LEVEL))
        ids = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        if len(word) <= 48:
            if len(self) >= self.max_entries:
                self.clear()
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """All ids of a text, four bytes each."""
        if ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, SPLIT.findall(text.lower())))


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, max_entries: int = 1_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and end_id, cut
    into pieces of capacity only where longer."""

    def factory():
        from tokenizers import Tokenizer

        words = WordIds(Tokenizer.from_file(tokenizer_file), max_entries)
        end, width = np.array([end_id], dtype="<u4").tobytes(), capacity * 4

        def step(cols):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                ids = words.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for name, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(v)
            return out

        return step

    return map_columns(docs.select("doc_id", "text"), factory, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that no packing can do without.

    For each t, pieces over capacity - t share a sequence with none of t or more, and
    those over half of capacity with none of their kind; what the rest (t or more) is
    beyond the room beside these needs sequences of its own."""
    if not counts[1:].any():
        return 0
    lengths = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * lengths)
    t = np.arange(capacity // 2 + 1)
    half, top = capacity // 2, capacity - t
    alone, paired = n[-1] - n[top], n[top] - n[half]
    rest = total[half] - np.where(t > 0, total[t - 1], 0)
    room = paired * capacity - (total[top] - total[half])
    return int((alone + paired + np.maximum(0, -((room - rest) // capacity))).max())


def _dominated(filling: list[int], waste: int, counts: np.ndarray) -> bool:
    """Whether a longer piece that is left could take the place of one of a filling, or be added to it."""
    used: dict[int, int] = {}
    for l in filling:
        used[l] = used.get(l, 0) + 1
    free = lambda x: counts[x] > used.get(x, 0)
    return any(free(x) for low in (0, *used) for x in (np.flatnonzero(counts[low + 1 : low + waste + 1]) + low + 1).tolist())


def completions(counts: np.ndarray, room: int, most: int = 1, nodes: int = 20_000) -> tuple[list[list[int]], int]:
    """Up to most undominated fillings of room by lengths (at most counts of each), the
    least waste first, and the nodes that finding them took.

    The first incumbent is the best-fit filling: again and again the longest piece that
    fits. Branch and bound then goes through fillings from long pieces to short ones, on
    a stack of its own. A branch ends when what is left of its room, were all shorter
    pieces put in, can't beat the worst incumbent; the search, when none wastes
    anything. nodes bounds the search; what is found by then stands."""
    present = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1] if x > 0]
    if not present:
        return [[]], 0
    left = [int(counts[l]) for l in present]
    below = np.cumsum([l * n for l, n in zip(reversed(present), reversed(left), strict=True)])[::-1].tolist()
    ascending = [-l for l in present]
    first, r = [], room
    for l, n in zip(present, left, strict=True):
        k = min(n, r // l)
        first += [l] * k
        r -= l * k
    found = [(r, first)]
    stack: list = [(0, room, None)]
    spent = 0
    while stack and spent < nodes and (len(found) < most or found[-1][0]):
        i, r, path = stack.pop()
        i = max(i, bisect_left(ascending, -r))
        worst = found[-1][0] if len(found) >= most else room + 1
        if i == len(present) or not r:
            filling = []
            while path:
                path, l, n = path
                filling += [l] * n
            filling.reverse()
            if r < worst and all(filling != f for _, f in found) and not _dominated(filling, r, counts):
                found = sorted([*found, (r, filling)], key=lambda x: x[0])[:most]
            continue
        if r - below[i] >= worst:
            continue
        spent += 1
        l = present[i]
        for n in range(min(left[i], r // l) + 1):
            stack.append((i + 1, r - l * n, (path, l, n) if n else path))
    return [f for _, f in found], spent


def bin_search(histogram: dict[int, int], capacity: int, nodes: int = 400_000, width: int = 3) -> tuple[list[tuple[list[int], int]], int]:
    """(lengths of a filling, how many sequences are filled so) that use every piece, and a lower bound of the sequences.

    Bins are completed around the longest piece left. A filling is used as often as its
    lengths last, so a plan has a few thousand entries however many pieces there are:
    its size depends on capacity, not on the data. The first plan takes the least
    waste each time and is the incumbent. Where it has as many sequences as the lower
    bound, that proves it the best, and the search ends. Else the search goes back: at
    each bin it branches between undominated fillings, and leaves a branch whose
    sequences so far and lower bound of the rest do not beat the incumbent. nodes bounds
    the whole search; the incumbent then stands, and the bound says how far it may be
    from the best."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for l, n in histogram.items():
        counts[l] = n
    bound = lower_bound(counts, capacity)
    best, best_size = None, None
    spent = 0

    def branches() -> list[list[int]]:
        nonlocal spent
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        found, cost = completions(counts, capacity - top, 1 if best is None else width)
        counts[top] += 1
        spent += cost + 1
        return [[top, *f] for f in found]

    def take(filling: list[int], times: int) -> None:
        for l in filling:
            counts[l] -= times

    plan: list[tuple[list[int], int]] = []
    open_branches: list[list[list[int]]] = []  # fillings still to try, at each bin of the plan and the next
    size = 0
    while True:
        if counts.any() and (best is None or size + lower_bound(counts, capacity) < best_size):
            open_branches.append(branches()[::-1])
        else:
            if not counts.any() and (best is None or size < best_size):
                best, best_size = plan.copy(), size
            if best_size == bound or spent >= nodes:
                return best, bound
            open_branches.append([])
        while not open_branches[-1]:
            open_branches.pop()
            if not plan:
                return best, bound
            filling, times = plan.pop()
            take(filling, -times)
            size -= times
        filling = open_branches[-1].pop()
        kinds, uses = np.unique(filling, return_counts=True)
        times = int((counts[kinds] // uses).min())
        take(filling, times)
        plan.append((filling, times))
        size += times


def bin_plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """The plan of bin_search alone."""
    return bin_search(histogram, capacity)[0]


def intervals(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks (ascending), sequence of the first rank, offset. The
    piece of rank r goes to sequence + r - first of the last interval begun."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        at = 0
        for l in filling:
            rows.setdefault(l, []).append((used.get(l, 0), sequence, at))
            used[l] = used.get(l, 0) + times
            at += l
        sequence += times
    return {l: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for l, r in rows.items()}


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    Text is read and tokenized once; what is shuffled are the pieces' numbers. They
    are dealt by range of length, so a partition has few lengths and a hot length
    fills several partitions; the driver gets one count for each partition and
    length it holds (at most partitions + capacity rows), plans the bins on the
    histogram, and each task then places its pieces by rank.

    Null text is empty: the end id alone. Null doc_ids and repeated rows are packed
    like any other row; pieces of equal length are told apart by where they were read; a
    very long text is cut into pieces of capacity; an empty table gives no rows; other
    columns are ignored."""
    spark = docs.sparkSession
    found = checkpointed(pieces(docs, tokenizer_file, capacity, end_id).withColumn("tie", F.monotonically_increasing_id()))
    dealt = checkpointed(found.repartitionByRange("length", "tie").drop("tie"))
    part = F.spark_partition_id()
    held = dealt.groupBy(part.alias("part"), "length").count().collect()
    histogram: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for p, l, n in sorted(held):
        first[p, l] = histogram.get(l, 0)
        histogram[l] = histogram.get(l, 0) + n
    table = spark.sparkContext.broadcast((first, intervals(bin_plan(histogram, capacity))))

    def factory():
        starts, plan = table.value
        seen: dict[tuple[int, int], int] = {}

        def step(cols):
            sequences, offsets = [], []
            for p, l in zip(cols["part"], cols["length"], strict=True):
                rank = seen.get((p, l))
                if rank is None:
                    rank = starts[p, l]
                seen[p, l] = rank + 1
                lows, bases, ats = plan[l]
                i = int(lows.searchsorted(rank, side="right")) - 1
                sequences.append(int(bases[i]) + rank - int(lows[i]))
                offsets.append(int(ats[i]))
            return cols | {"sequence_id": sequences, "offset": offsets}

        return step

    return map_columns(dealt.withColumn("part", part), factory, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
