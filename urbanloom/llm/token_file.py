"""Token ids in a binary file format: adaptive context-mixing range coder over independently reset, checksummed blocks.

A segment holds the ids of consecutive whole documents and says which they are. Its bytes, all numbers little-endian::

    4 bytes  magic "ULT2"
    uint32   number of ids, ids of a block, number of blocks, bytes of the index
    index    zlib of JSON: ids before the segment in its part, document ids, and how many ids each document has
    blocks   uint32 coded 32-bit words, crc32 of the block's ids, one pair for each block
    words    uint32 coded words of all blocks, one block after the other

A block codes its ids one by one. Three models that start empty in every block speak about the next id: order 2 and
order 1 each name the id that last followed the same two ids or the same id (told apart by a hash), and how often in a
row such a name was right; order 0 has the frequencies of all ids of the block up to the last refresh. What is new to
all of them has a fixed probability that falls with the id. How often each model was right, where the two names were
this sure of themselves, mixes the four into one distribution, and a single range-coder step codes the id in it. All
blocks of a segment step together, one id of each at a time, so numpy does the arithmetic; the writer knows all ids and
finds what the models said about them before it steps.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import byte_letters
from .common import text_runs, written

MAGIC = b"ULT2"
BLOCK = 2048
#: A segment is closed at the first document end after so many ids.
SEGMENT = 4_000_000
#: Slots of the order-1 and order-2 tables of a block.
SLOTS = 2048
#: Contexts of the mixing: how sure order 2 and order 1 are, 0 (no name) to 4 each.
SURE, CONTEXTS = 5, 32
#: Blocks whose models the writer works out at a time.
GROUP = 32
#: Distinct words, and distinct pieces of words, whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Marks that are pre-tokens of their own after letters.
MARKS = frozenset(".,;:!?")


def _falling() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and width of each id in the fixed distribution of new ids, and the id of each place; as integers, so all machines agree."""
    width = 1 + 160_000 // (np.arange(1 << 16) + 256)
    return np.cumsum(width) - width, width, np.repeat(np.arange(1 << 16, dtype=np.int32), width)


def _first_shares() -> np.ndarray:
    """What each context counts for order 2, order 1, order 0 and new ids before it has seen any."""
    out = np.zeros((CONTEXTS, 4), np.int32)
    for two in range(SURE):
        for one in range(SURE):
            out[two * SURE + one] = 4 * two, 3 * one, 6, 3
    out[SURE * SURE :] = 1
    return out


BEGIN, WIDTH, OF_PLACE = _falling()
NEW = len(OF_PLACE)
#: What a place of the fixed distribution stands for: begin << 28 | width << 16 | id.
TOLD_NEW = (BEGIN << 28 | WIDTH << 16 | np.arange(1 << 16))[OF_PLACE]
#: Counts of the four models of a context lie in one integer, 16 bits each; a product with ALL has their sum on top.
FIRST = (_first_shares().astype(np.int64) << np.arange(0, 64, 16)).sum(axis=1)
ONCE, ALL, COUNT = 1 << np.arange(0, 64, 16), (1 << 48) + (1 << 32) + (1 << 16) + 1, 0xFFFF
#: The reader has orders 2 and 1 in bits 0 and 32, order 0 and new ids in bits 16 and 48, so that one product has both names' shares.
FIRST_READ, PAIR = (_first_shares().astype(np.int64) << np.array([0, 32, 16, 48])).sum(axis=1), COUNT << 32 | COUNT
#: Shares are whole 4096ths; RATE[x] turns counts that add up to x into them.
RATE = ((4092 << 14) // np.maximum(np.arange(2 * BLOCK + 64), 1)).astype(np.int64)
#: Steps before which order 0 takes in the block's ids so far.
REFRESH = (32, 128, 384, 768, 1280)


def _slots(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of order 1 and order 2."""
    mixed = last * 40503
    return mixed >> 5 & SLOTS - 1, (mixed + before * 9973 >> 3) & SLOTS - 1


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of (blocks, n) in the order of a small key within each block, and the keys; equal keys stay in order."""
    n = key.shape[1]
    both = np.sort(key * BLOCK + np.arange(n, dtype=np.int32), axis=1)
    return ((both & BLOCK - 1) + np.arange(len(key), dtype=np.int32)[:, None] * n).ravel(), both >> BLOCK.bit_length() - 1


def _named(slot: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """2 * how sure the slot is (0 if it is empty, else 1 to 4) + whether the id that last followed in it is the id itself."""
    order, sorted_slot = _sorted(slot)
    follows = ids.ravel().take(order).reshape(slot.shape)
    place = np.arange(slot.shape[1], dtype=np.int32)
    same = sorted_slot[:, 1:] == sorted_slot[:, :-1]
    hit = np.zeros(slot.shape, bool)
    hit[:, 1:] = same & (follows[:, 1:] == follows[:, :-1])
    missed = np.maximum.accumulate(np.where(hit, 0, place), axis=1)
    named = hit.astype(np.int32)
    named[:, 1:] += same * (2 + 2 * np.minimum(place[:-1] - missed[:, :-1], 3))
    out = np.empty(slot.size, np.int32)
    out[order] = named.ravel()
    return out.reshape(slot.shape)


def _spans(ids: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, width) in a range of 2 ** 32 of each id of some blocks (blocks, BLOCK), as the reader's models will have them.

    ``runs`` is room for where the run of each id of each block begins and ends, (2, blocks * 65536) whatever they hold.
    """
    n, steps = ids.shape
    ids = ids.astype(np.int32)
    last, before = np.zeros_like(ids), np.zeros_like(ids)
    last[:, 1:], before[:, 2:] = ids[:, :-1], ids[:, :-2]
    one, two = (_named(slot, ids) for slot in _slots(last, before))
    begin, count, known = np.zeros(ids.shape, np.int64), np.zeros(ids.shape, np.int64), np.ones(steps, np.int64)
    marks = [t for t in REFRESH if t < steps]
    lane = np.arange(n)[:, None]
    for t, until in zip(marks, [*marks[1:], steps]):
        known[t:until] = t
        s = np.sort(ids[:, :t], axis=1)
        place, of = np.tile(np.arange(t, dtype=np.uint16), n), (s + (lane << 16)).ravel()
        runs[0][of[::-1]] = place[::-1]  # the first of equal ids is written last
        runs[1][of] = place + 1
        asked = ids[:, t:until] + (lane << 16)
        from_ = np.minimum(runs[0].take(asked), t - 1).astype(np.int32)
        found = s.ravel().take(from_ + lane * t) == ids[:, t:until]  # an id that has no run finds what is left from others
        begin[:, t:until] = from_
        count[:, t:until] = (runs[1].take(asked) - from_) * found
    outcome = np.where(two & 1, 0, np.where(one & 1, 1, 3 - (count > 0)))
    order, of = _sorted((two >> 1) * SURE + (one >> 1))
    what = outcome.ravel().take(order).reshape(n, steps)
    opens = np.ones(of.shape, bool)
    opens[:, 1:] = of[:, 1:] != of[:, :-1]
    once = ONCE.take(what)
    seen = np.cumsum(once, axis=1) - once
    seen -= np.maximum.accumulate(seen * opens, axis=1)
    counts = seen
    counts <<= 1
    counts += FIRST.take(of)
    rate = RATE.take(counts * ALL >> 48)
    packed = 1 + ((counts >> 16 * what & COUNT) * rate >> 14)
    for k in range(3):
        packed += (1 + ((counts >> 16 * k & COUNT) * rate >> 14) << 13) * (what > k)
    shares = np.empty(n * steps, np.int64)
    shares[order] = packed.ravel()
    shares = shares.reshape(n, steps)
    named, new = outcome < 2, outcome == 3
    unit = (shares & 0x1FFF) << 20
    start = shares >> 13 << 20
    begin *= ~named
    count[named] = 1
    parts = np.where(named, 1, known)
    at = np.flatnonzero(new)
    fresh = ids.ravel().take(at)
    begin.ravel()[at], count.ravel()[at], parts.ravel()[at] = BEGIN.take(fresh), WIDTH.take(fresh), NEW
    unit = unit.view(np.uint64) // parts.view(np.uint64)
    start = start.view(np.uint64)
    start += unit * begin.view(np.uint64)
    return start, unit * count.view(np.uint64)


class Reader:
    """The models of n blocks that step together while they are read; ids are below 65536."""

    def __init__(self, n: int):
        self.slots, self.contexts = np.arange(n) * SLOTS, np.arange(n, dtype=np.int32) * CONTEXTS
        self.one, self.two = np.full(n * SLOTS, -8, np.int32), np.full(n * SLOTS, -8, np.int32)  # id * 8 + how sure; -8 is empty
        self.counts = np.tile(FIRST_READ, n)  # twice the times, above the first shares
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.known = 1
        self.told = np.full(n, 1 << 16)

    def narrow(self, n: int) -> None:
        """Keep the first n blocks; the others have ended."""
        self.slots, self.contexts, self.last, self.before = (x[:n] for x in (self.slots, self.contexts, self.last, self.before))

    def refresh(self, ids: np.ndarray) -> None:
        """Order 0 takes in (blocks, n) ids: for each place in their order, begin << 28 | length << 16 | id of its run."""
        n = self.known = ids.shape[1]
        self.told = np.empty(ids.size, np.int64)
        place = np.arange(n, dtype=np.int64)
        for k in range(0, len(ids), GROUP):
            s = np.sort(ids[k : k + GROUP], axis=1, kind="stable")
            same = s[:, 1:] == s[:, :-1]
            begin, end = np.zeros(s.shape, np.int64), np.full(s.shape, n)
            begin[:, 1:] = ~same * place[1:]
            end[:, :-1] = np.where(same, n, place[1:])
            begin = np.maximum.accumulate(begin, axis=1)
            end = np.minimum.accumulate(end[:, ::-1], axis=1)[:, ::-1]
            self.told[k * n : k * n + s.size] = (begin << 28 | end - begin << 16 | s).ravel()

    def step(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, start, width) of the ids whose spans hold the values; the models learn them."""
        at_one, at_two = _slots(self.last, self.before)
        at_one += self.slots
        at_two += self.slots
        was_one, was_two = self.one.take(at_one), self.two.take(at_two)
        sure_one, sure_two = was_one & 7, was_two & 7
        context = sure_two * SURE + sure_one + self.contexts
        counts = self.counts.take(context)
        rate = RATE.take(counts * ALL >> 48)
        both = (counts & PAIR) * rate  # two products that do not meet
        edge_two = (both << 6 & 0xFFF << 20) + (1 << 20)
        share_one = (both >> 46 << 20) + (1 << 20)
        edge_one = edge_two + share_one
        by_two = value < edge_two
        id_one, id_two = was_one >> 3, was_two >> 3
        ids = np.where(by_two, id_two, id_one)
        start = np.where(by_two, 0, edge_two)
        width = np.where(by_two, edge_two, share_one)
        gain = np.where(by_two, 2, 2 << 32)
        rows = np.flatnonzero(value >= edge_one)
        if rows.size:
            of, rates = counts.take(rows), rate.take(rows)
            base = edge_one.take(rows)
            beyond = value.take(rows) - base
            share = ((of >> 16 & COUNT) * rates << 6 & 0xFFF << 20) + (1 << 20)
            new = np.flatnonzero(beyond >= share)
            parts = np.full(len(rows), self.known)
            if new.size:
                over = share.take(new)
                base[new] += over
                beyond[new] -= over
                share[new] = ((of.take(new) >> 48) * rates.take(new) >> 14 << 20) + (1 << 20)
                parts[new] = NEW
            unit = (share.view(np.uint64) // parts.view(np.uint64)).view(np.int64)
            place = np.minimum((beyond.view(np.uint64) // unit.view(np.uint64)).view(np.int64), parts - 1)
            told = self.told.take(rows * self.known + np.minimum(place, self.known - 1))
            told[new] = TOLD_NEW.take(place.take(new))
            more = np.full(len(rows), 2 << 16)
            more[new] = 2 << 48
            gain[rows] = more
            ids[rows] = told & 0xFFFF
            start[rows] = base + unit * (told >> 28)
            width[rows] = unit * (told >> 16 & 0xFFF)
        self.counts[context] = counts + gain
        fresh = (ids << 3) + 1
        # a name that was right becomes surer, up to 4; any other gives way
        self.one[at_one] = np.where(id_one == ids, was_one + (sure_one < 4), fresh)
        self.two[at_two] = np.where(by_two, was_two + (sure_two < 4), fresh)
        self.before, self.last = self.last, ids.astype(np.int64)
        return ids, start, width


def _lanes(total: int) -> np.ndarray:
    """Ids of each block: all full but the last."""
    count = -(-total // BLOCK)
    return np.minimum(BLOCK, total - np.arange(count) * BLOCK)


def pack(ids: np.ndarray, index: dict | None = None) -> bytes:
    """A segment's bytes; ids are whole numbers below 65536."""
    sizes = _lanes(len(ids))
    n = len(sizes)
    told = zlib.compress(json.dumps(index or {}, separators=(",", ":")).encode(), 1)
    head = MAGIC + np.array([len(ids), BLOCK, n, len(told)], "<u4").tobytes() + told
    if not n:
        return head
    padded = np.zeros(n * BLOCK, np.int64)
    padded[: len(ids)] = ids
    blocks = padded.reshape(n, BLOCK)
    starts, widths = np.empty((n, BLOCK), np.uint64), np.empty((BLOCK, n), np.uint64)
    runs = np.zeros((2, min(n, GROUP) << 16), np.uint16)
    for k in range(0, n, GROUP):
        starts[k : k + GROUP], width = _spans(blocks[k : k + GROUP], runs)
        widths[:, k : k + GROUP] = width.T
    # the code of a block is the sum of unit * start over its ids, each 32 bits further right for every shift of the span before
    # it; only the spans need to be stepped through, and what is added at one place is summed as two halves
    half, small, low_half = np.uint64(32), np.uint64(1 << 32), np.uint64(0xFFFFFFFF)
    span, unit, short = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64), np.empty(n, np.uint64), np.zeros((BLOCK, n), bool)
    steps = int(sizes[0])
    for width, shifts in zip(widths[:steps], short[:steps]):  # what a last, shorter block has beyond its end is not looked at
        np.right_shift(span, half, out=unit)
        np.multiply(unit, width, out=span)
        np.less(span, small, out=shifts)
        np.left_shift(span, half, out=span, where=shifts)
        width[:] = unit
    short[sizes[-1] :, -1] = False
    out, used = np.zeros((n, BLOCK + 4), np.uint64), short.sum(axis=0) + 2
    for k in range(0, n, GROUP):
        terms = starts[k : k + GROUP]
        terms *= widths[:, k : k + GROUP].T
        above, below, shifts = terms >> half, terms & low_half, short[:, k : k + GROUP].T.copy()
        for i, steps in enumerate(sizes[k : k + GROUP].tolist()):
            at = np.concatenate([[0], np.flatnonzero(shifts[i, : steps - 1]) + 1])
            out[k + i, : len(at)] = np.add.reduceat(above[i, :steps], at)
            out[k + i, 1 : len(at) + 1] += np.add.reduceat(below[i, :steps], at)
    while (over := out >> half).any():  # carries that run on
        out &= low_half
        out[:, :-1] += over[:, 1:]
    words = np.concatenate([out[i, :k] for i, k in enumerate(used.tolist())]).astype("<u4")
    flat = padded.astype("<u4")
    checks = [zlib.crc32(flat[i * BLOCK : i * BLOCK + k].tobytes()) for i, k in enumerate(sizes.tolist())]
    return head + np.stack([used, checks], axis=1).astype("<u4").tobytes() + words.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, dict]:
    """The ids of a segment and its index; a block whose checksum differs raises."""
    return unpack_all([data])[0]


def unpack_all(segments: list[bytes]) -> list[tuple[np.ndarray, dict]]:
    """``unpack`` of each segment; the blocks of all of them step together."""
    totals, indexes, all_sizes, all_used, all_checks, all_words = [], [], [], [], [], []
    for data in segments:
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        total, block, n, told = np.frombuffer(data, "<u4", 4, 4).tolist()
        if block != BLOCK:
            raise ValueError(f"blocks of {block} ids")
        indexes.append(json.loads(zlib.decompress(data[20 : 20 + told])))
        body = memoryview(data)[20 + told :]
        used, checks = np.frombuffer(body, "<u4", 2 * n).reshape(n, 2).astype(np.int64).T
        totals.append(total)
        all_used.append(used)
        all_checks.append(checks)
        all_sizes.append(_lanes(total))
        all_words.append(np.frombuffer(body, "<u4", offset=8 * n).astype(np.uint64))
    sizes, used, checks = (np.concatenate(x) for x in (all_sizes, all_used, all_checks))
    words = np.concatenate([*all_words, np.zeros(2, np.uint64)])
    columns = _step_through(sizes, np.cumsum(used) - used, words)
    out, lane = [], 0
    for total, index, of in zip(totals, indexes, all_sizes):
        ids = columns[lane : lane + len(of)].ravel()[:total].astype("<u4")
        for i, k in enumerate(of.tolist()):
            if zlib.crc32(ids[i * BLOCK : i * BLOCK + k].tobytes()) != checks[lane + i]:
                raise ValueError(f"block {i} is damaged")
        out.append((ids, index))
        lane += len(of)
    return out


def _step_through(sizes: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids (blocks, BLOCK) of blocks of these sizes whose coded words begin at these places."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")  # those that end first are last
    sizes, at = sizes[order], at[order]
    reader = Reader(n)
    code = (words[at] << np.uint64(32)) | words[at + 1]
    at = at + 2
    low, span = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    columns = np.zeros((BLOCK, n), np.uint16)
    half, small, most = np.uint64(32), np.uint64(1 << 32), np.uint64((1 << 32) - 1)
    active = n
    for t in range(int(sizes[0]) if n else 0):
        if sizes[active - 1] <= t:
            active = int(np.searchsorted(-sizes, -t))
            reader.narrow(active)
        if t in REFRESH:
            reader.refresh(np.ascontiguousarray(columns[:t, :active].T))
        lo, sp, co = low[:active], span[:active], code[:active]
        unit = sp >> half
        value = np.minimum((co - lo) // unit, most)
        ids, start, width = reader.step(value.view(np.int64))
        columns[t, :active] = ids
        lo += unit * start.view(np.uint64)
        np.multiply(unit, width.view(np.uint64), out=sp)
        short = np.flatnonzero(sp < small)
        if short.size:
            lo[short] <<= half
            sp[short] <<= half
            next_word = at.take(short)
            co[short] = (co.take(short) << half) | words.take(next_word, mode="clip")
            at[short] = next_word + 1
    out = np.empty((n, BLOCK), np.uint16)
    out[order] = columns.T
    return out


class WordEncoder:
    """The library's tokenizer, whose model runs on each distinct pre-token once, for all new ones of some texts in one call.

    Its normaliser is NFC, one space for white space, lower case; its pre-tokens hold no white space and are written
    as byte letters. Texts that are not NFC or hold a character whose lower case depends on its neighbours or that
    Python alone takes for white space go through the library whole, and so do texts that hold an added token and words
    that Python cannot print.
    """

    ODD = tuple("\x1c\x1d\x1e\x1f\u03a3\u0130")

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.lines = Tokenizer(self.model)  # the model alone, on pre-tokens in byte letters, one a line
        self.lines.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        told = json.loads(spec)
        self.suffix = told["model"].get("end_of_word_suffix")
        self.is_end = np.zeros(1 << 16, bool)
        if self.suffix:
            self.is_end[[i for t, i in told["model"]["vocab"].items() if t.endswith(self.suffix)]] = True
        self.split = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.added = tuple(t["content"].lower() for t in told.get("added_tokens") or ())
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def model_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token, from one call of the library for all of them."""
        letters = [p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        if self.suffix and not any(self.suffix in x for x in letters):
            ids = np.array(self.lines.encode_batch_fast(["\n".join(letters)], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(pieces) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), (2 * ends).tolist()
                return [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return [array("H", [t.id for t in self.model.tokenize(x)]).tobytes() for x in letters]

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of new words, which are in lower case and without white space; they are remembered."""
        parts, sizes = [], []
        for word in words:
            if word.isalpha():  # letters alone, or with one mark after them, need no search
                parts.append(word)
                sizes.append(1)
            elif word[-1:] in MARKS and word[:-1].isalpha():
                parts += (word[:-1], word[-1])
                sizes.append(2)
            elif word.isprintable():
                found = self.split(word)
                parts += found
                sizes.append(len(found))
            else:  # it may hold a character that only the library's Unicode has; a blank keeps it apart from pre-tokens
                parts.append(" " + word)
                sizes.append(1)
                self.pieces[" " + word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        fresh = list(dict.fromkeys(p for p in parts if p not in self.pieces))
        if fresh:
            self.pieces.update(zip(fresh, self.model_ids(fresh)))
        ids = map(self.pieces.__getitem__, parts)
        made = [next(ids) if n == 1 else b"".join(islice(ids, n)) for n in sizes]
        self.known.update(zip(words, made))
        return made

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (none for null) as little-endian unsigned 16-bit integers."""
        for memory in (self.known, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()
        whole, lowered = {}, []
        for i, text in enumerate(texts):
            lower = text.lower() if text else ""
            if lower and (any(c in text for c in self.ODD) or not is_normalized("NFC", text) or any(t in lower for t in self.added)):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
                lower = ""
            lowered.append(lower)
        split = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
        number = split.flatten().dictionary_encode()
        words = number.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        if new := [i for i, known in enumerate(ids) if known is None]:
            for i, made in zip(new, self.learn([words[i] for i in new])):
                ids[i] = made
        # the ids of all texts in a row: those of each word, from where they lie among the distinct words' ids
        pool, length = np.frombuffer(b"".join(ids), "<u2"), np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        at = number.indices.to_numpy()
        counts = length.take(at)
        ends = np.concatenate([[0], np.cumsum(counts)])
        raw = pool.take(np.repeat((np.cumsum(length) - length).take(at) - ends[:-1], counts) + np.arange(ends[-1])).tobytes()
        cuts = (2 * ends.take(split.offsets.to_numpy())).tolist()
        return [whole.get(i) or raw[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@lru_cache(maxsize=1)
def _encoder(spec: str) -> WordEncoder:
    """One encoder a worker process, so that later tasks find the words of earlier ones."""
    return WordEncoder(spec)


def write_segments(docs: DataFrame, spec: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts in ascending id order and write segments to the shared folder; the written table.

    Rows: (part, n_ids, payload), a segment each; ``part`` numbers the ranges of ids. A payload alone can be read back: it
    names its documents (numbers or text), their numbers of ids and the ids before it in its part. Null and empty texts
    have the end id alone; texts of any length are taken whole. Equal ids, null ones too, come in the order of a hash of
    their text, equal rows one after the other; null ids are first. Only the two named columns are read. An empty table
    writes no segment.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    parts = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(id_col, text, F.xxhash64(text).alias("_h"))
    ordered = rows.repartitionByRange(parts, id_col, "_h").sortWithinPartitions(id_col, "_h").select(id_col, text, F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(shared.value), np.array([end_id], "<u2").tobytes()
        part = before = held = 0
        doc_ids: list = []
        counts: list[int] = []
        coded: list[bytes] = []

        def close() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(coded), "<u2").astype(np.int64), {"before": before, "docs": doc_ids, "counts": counts})
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], ["part", "n_ids", "payload"])

        for batch, texts in text_runs(batches):
            for i, ids, part in zip(batch.column(0).to_pylist(), encoder.encode_all(texts), batch.column(2).to_pylist()):  # noqa: B007
                ids += end
                doc_ids.append(i)
                counts.append(len(ids) // 2)
                coded.append(ids)
                held += len(ids) // 2
                if held >= SEGMENT:
                    yield close()
                    before, held = before + held, 0
                    doc_ids, counts, coded = [], [], []
        if doc_ids:
            yield close()

    return written(ordered.mapInArrow(run, "part int, n_ids long, payload binary"), "tokens")


def read_segments(segments: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the written segments alone; start: ids of all documents before it."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    offsets = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("of_part"))  # a row a part
    kind = F.lit(None).cast(id_type)
    arrow = segments.sparkSession.range(0).select(kind.alias("x")).toArrow().schema.field(0).type

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
        """Segments to step through together: at most two full ones, or more that hold no more ids."""
        held, ids = [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = int.from_bytes(row[1][4:8], "little")
                if held and ids + more > 2 * SEGMENT:
                    yield held
                    held, ids = [], 0
                held.append(row)
                ids += more
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            for of_part, (ids, index) in zip((r[0] for r in batch), unpack_all([r[1] for r in batch])):
                counts = index["counts"]
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                checks = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), counts)]
                columns = [pa.array(index["docs"], arrow), pa.array(ends - counts + of_part + index["before"], pa.int64()), pa.array(counts, pa.int64()), pa.array(checks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32"])

    rows = segments.join(F.broadcast(offsets), "part").select("of_part", "payload")
    return rows.mapInArrow(run, f"{id_col} {id_type}, start long, n_tokens long, ids_crc32 long")
