"""Hierarchical packing of tokenised documents into context windows of several lengths.

Each partition is packed on its own in one narrow pass, in buffers of bounded size:
1. Whole windows of the longest tier are cut from long documents; they wait in the buffer, to be dealt with the others. What
   remains is routed to the smallest tier that holds it.
2. Tiers are packed from longest to shortest. A window starts with the longest document of its tier; its gap is filled
   with the longest shorter documents that fit, and closed by cutting one more, so the window has no padding.
3. What no shorter document can complete waits for the next buffer; at the end of a partition it is cut into
   power-of-two lengths, which need no padding either.
4. Windows of one tier are dealt to step groups: sorted by attention cost (the sum of squared piece lengths) and dealt
   back and forth, so the groups of a buffer cost nearly the same. Windows too few for DEAL_GROUPS groups wait for the next buffer.
No piece crosses a partition, and a repeated task gives the same pieces and ids.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from framewright.llm.common import arrow_map, batch, worker_state

#: Context lengths, ascending powers of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens that a partition buffers before it packs.
BUFFER_TOKENS = 1 << 20
#: Windows in a step group.
STEP_WINDOWS = 16
#: Step groups of a tier that are dealt at once, at least.
DEAL_GROUPS = 8
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary()),
])
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


class Encoder:
    """Ids of whole texts by a word-end BPE `tokenizers` file that lower-cases, through a cache of words.

    Words never cross white space. A text with the separators U+001C to U+001F, which Python counts as white space and
    the tokenizer doesn't, is encoded in one piece. Special tokens in a text are ordinary text. A word of Latin-1 letters
    with nothing or ASCII punctuation after it is one letter word and one run of punctuation to the tokenizer: its parts
    skip normalisation, share entries, and are encoded together, to be told apart by their word ends.
    """

    #: Words kept, at most; then the cache starts anew.
    ENTRIES = 700_000
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.bare, self.known, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path), {}, _byte_letters()
        self.whole.encode_special_tokens = self.bare.encode_special_tokens = True
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.bare.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def __call__(self, text: str) -> np.ndarray:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        words, known = text.split(), self.known
        missing = set(words).difference(known)
        if missing:
            if len(known) > self.ENTRIES:
                known.clear()
                missing = set(words)
            self._learn(missing)
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")

    def _learn(self, words: set[str]) -> None:
        known, split, other = self.known, [], []
        for w in words:
            if m := self.PLAIN.fullmatch(w):
                split.append((w, m[1].lower(), m[2]))
            else:
                other.append(w)
        new = list({p for _, *own in split for p in own if p and p not in known})
        if new:
            line = " ".join(new) if all(map(str.isascii, new)) else " ".join(w.encode().decode("latin-1").translate(self.letters) for w in new)
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            at = 0
            for w, end in zip(new, (np.flatnonzero(self.ends[ids]) + 1).tolist(), strict=True):
                known[w] = ids[at:end].tobytes()
                at = end
        for w, letters, rest in split:
            known[w] = known[letters] + known[rest] if letters and rest else known[letters or rest]
        for w, e in zip(other, self.whole.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()


class Packer:
    """Packs pieces (length, order, doc_id, start, ids, doc_tokens) into windows; keeps at most a buffer and a remainder."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers, self.base, self.windows, self.groups = tiers, partition << 33, 0, 0
        self.waiting: list[tuple] = []  # ascending by length; `order` makes entries distinct
        self.whole: list[list[tuple]] = []  # windows of one piece
        self.left: list[list[tuple]] = []  # windows that wait for a full step group: fewer than DEAL_GROUPS * STEP_WINDOWS of each tier
        self.tokens = self.order = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Windows that can be closed now, each a list of pieces."""
        top, at = self.tiers[-1], 0
        for s in range(0, len(ids) // top * top, top):
            self.whole.append([(top, 0, doc_id, s, ids[s : s + top], len(ids))])
            self.tokens += top
            at = s + top
        if at < len(ids):
            self._wait(doc_id, at, ids[at:], len(ids))
        if self.tokens >= BUFFER_TOKENS:
            yield from self._pack()

    def close(self) -> Iterator[list[tuple]]:
        yield from self._pack()
        last, self.waiting = self.waiting, []
        left, windows = sum(x[0] for x in last), []
        while left:
            size = min(self.tiers[-1], 1 << left.bit_length() - 1)
            left -= size
            window = []
            while size:
                n, order, doc_id, start, ids, total = last.pop()
                window.append((min(n, size), order, doc_id, start, ids[:size], total))
                if n > size:
                    last.append((n - size, order, doc_id, start + size, ids[size:], total))
                size -= min(n, size)
            windows.append(window)
        yield from self._deal(windows, last=True)

    def _wait(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        self.order += 1
        insort(self.waiting, (len(ids), self.order, doc_id, start, ids, total), key=lambda x: x[:2])
        self.tokens += len(ids)

    def _take(self, most: int) -> tuple | None:
        """The longest waiting piece of at most `most` tokens."""
        i = bisect_right(self.waiting, most, key=lambda x: x[0])
        return self.waiting.pop(i - 1) if i else None

    def _pack(self) -> Iterator[list[tuple]]:
        windows, kept, self.whole = self.whole, [], []
        while self.waiting:
            window = [self.waiting.pop()]
            tier = next(t for t in self.tiers if t >= window[0][0])
            gap = tier - window[0][0]
            while gap and (x := self._take(gap)):
                window.append(x)
                gap -= x[0]
            if gap and self.waiting:
                n, order, doc_id, start, ids, total = self.waiting.pop(0)  # every one left is longer than the gap
                window.append((gap, order, doc_id, start, ids[:gap], total))
                insort(self.waiting, (n - gap, order, doc_id, start + gap, ids[gap:], total), key=lambda x: x[:2])
                gap = 0
            if gap:
                kept += window
            else:
                windows.append(window)
        self.waiting = sorted(kept, key=lambda x: x[:2])
        self.tokens = sum(x[0] for x in kept)
        yield from self._deal(windows)

    def _deal(self, windows: list[list[tuple]], last: bool = False) -> Iterator[list[tuple]]:
        """Number the windows and deal those of each tier to step groups of nearly equal cost; `last`: the unfilled ones too."""
        by_tier: dict[int, list] = {}
        for w in self.left + windows:
            by_tier.setdefault(sum(x[0] for x in w), []).append(w)
        self.left = []
        for tier, own in sorted(by_tier.items()):
            own.sort(key=lambda w: -sum(x[0] ** 2 for x in w))
            if not last:
                full = len(own) // STEP_WINDOWS * STEP_WINDOWS if len(own) >= DEAL_GROUPS * STEP_WINDOWS else 0
                self.left += own[full:]
                del own[full:]
            count = -(-len(own) // STEP_WINDOWS)
            for i, w in enumerate(own):
                turn, place = divmod(i, count)
                group, offset = place if turn % 2 == 0 else count - 1 - place, 0
                rows = []
                for n, _, doc_id, start, ids, total in w:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc_id, start, n, zlib.crc32(raw), total, self.base + self.windows, offset, tier, self.base + self.groups + group, raw))
                    offset += n
                self.windows += 1
                yield rows
            self.groups += count


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in PIECES' columns; a document's ids are those of its text, then `end_id`.

    Null texts count as empty (one piece with the end id), null ids stay null, repeated rows are documents of their own.
    `tokenizer` is the path of a `tokenizers` file that all machines have. Without `with_ids`, ids is null.
    Other columns are not read; an empty table gives an empty result.
    """

    state = f"encoder {tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = worker_state(state, lambda: Encoder(tokenizer)), Packer(TaskContext.get().partitionId()), []
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return batch(PIECES, *columns[:-1], columns[-1] if with_ids else pa.nulls(len(columns[0]), pa.binary()))

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for window in packer.add(i, np.concatenate([encode(t or ""), end])):
                    rows += window
                if len(rows) >= 2000:
                    yield flush()
        for window in packer.close():
            rows += window
        if rows:
            yield flush()

    return arrow_map(df.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text"), run, PIECES_SCHEMA, keeps=state)
