"""Ids of the tokenizers library, with a bounded memory of what pieces of text encode to."""

from __future__ import annotations

import re

import numpy as np

from .common import U64, piece_hashes

#: White space to some pattern libraries only.
ODD = re.compile("[\x1c-\x1f\x85]")
LETTER, DIGIT, MARK, QUOTE, WHITE, SOLID, UNSURE = range(7)
#: Slots of the memory, a power of two; it starts anew before half of them are in use.
SLOTS = 1 << 21
#: Pieces looked up at once, and ids that the memory holds at most before it starts anew.
STEP, MOST_IDS = 1 << 17, 1 << 23


def _ascii_classes() -> np.ndarray:
    c = np.full(256, SOLID, np.uint8)
    for b in range(128):
        x = chr(b)
        c[b] = LETTER if x.isalpha() else DIGIT if x.isdigit() else WHITE if b in (9, 10, 11, 12, 13, 32) else UNSURE if 28 <= b <= 31 else QUOTE if x == "'" else MARK
    return c


_CLASS = _ascii_classes()


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """Class of each byte of UTF-8 text. Letters beyond ASCII are told apart up to U+00FF; other characters are SOLID, white space excepted."""
    c = _CLASS[raw]

    def mark(lead: int, kind: int, fits) -> None:
        at = np.flatnonzero(raw == lead)
        tail = np.stack([raw[np.minimum(at + k, len(raw) - 1)] for k in (1, 2)])
        ok, size = fits(*tail)
        for k in range(size):
            c[at[ok] + k] = kind

    if len(raw) and raw.max() >= 128:
        mark(0xC3, LETTER, lambda x, _: ((x != 0x97) & (x != 0xB7), 2))
        mark(0xC2, UNSURE, lambda x, _: (x == 0x85, 2))
        mark(0xC2, WHITE, lambda x, _: (x == 0xA0, 2))
        mark(0xE1, WHITE, lambda x, y: ((x == 0x9A) & (y == 0x80), 3))
        mark(0xE2, WHITE, lambda x, y: ((x == 0x80) & ((y <= 0x8A) | (y == 0xA8) | (y == 0xA9) | (y == 0xAF)) | (x == 0x81) & (y == 0x9F), 3))
        mark(0xE3, WHITE, lambda x, y: ((x == 0x80) & (y == 0x80), 3))
    return c


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each piece of the rows' text, and whether it is one match of the byte-level pattern for sure.

    The pattern never has a match across a piece's start: that is, before white space after
    something solid, between letters, digits and marks, and after a lone white character that is
    no space. So pieces encode independently of one another.
    """
    n = len(raw)
    c = byte_classes(raw)
    cut = np.zeros(n + 1, bool)
    a, b = c[:-1], c[1:]
    cut[1:-1] = (b == WHITE) & (a != WHITE) & (a != UNSURE)
    cut[1:-1] |= (a != b) & (a <= MARK) & (b <= MARK)
    lone = (a == WHITE) & (raw[:-1] < 32) & (b != WHITE) & (b != UNSURE)
    lone[1:] &= cut[1:-2]
    cut[1:-1] |= lone
    cut[offsets] = True
    starts = np.flatnonzero(cut[:-1])
    # bytes that spoil a piece: all but letters, digits and marks; a space may come first
    spoilt = c > MARK
    spoilt[starts] &= raw[starts] != 32
    sums = np.concatenate([[0], np.cumsum(spoilt)])
    ends = np.append(starts[1:], n)
    return starts, (sums[ends] == sums[starts]) & ((ends - starts > 1) | (c[starts] <= MARK))


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceMemory:
    """Ids of whole texts, piece by piece, with a bounded memory of what pieces encode to.

    The memory has an entry for each piece met, by a 64-bit hash of its bytes: its ids lie
    together in one array. Of ``most`` entries, or too many ids, it starts anew. Only new pieces
    are parted into matches of the pattern and encoded, by ``word_ids``.
    """

    def __init__(self, pattern: str, most: int = 800_000):
        import regex

        self.find, self.most = regex.compile(pattern).findall, most
        self._forget()

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches, one after another, and how many each has."""
        raise NotImplementedError

    def odd_ids(self, piece: str) -> np.ndarray | None:
        """Ids of a piece whose matches the pattern here does not tell."""
        return None

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros(SLOTS, U64), np.zeros(SLOTS, np.int32)
        self.n, self.used = 0, 0
        self.first, self.count, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        at, slot = None, self._slots(h)
        while at is None or len(at):
            own = h if at is None else h[at]
            key = self.keys[slot]
            hit = np.flatnonzero(key == own)
            out[hit if at is None else at[hit]] = self.entry[slot[hit]]
            go = np.flatnonzero((key != own) & (key != 0))
            at, slot = go if at is None else at[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _add(self, h: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """New entries of distinct hashes, with their numbers of ids."""
        def grown(x: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
            if used + len(new) > len(x):
                x = np.concatenate([x, np.zeros(max(len(x), used + len(new) - len(x)), x.dtype)])
            x[used : used + len(new)] = new
            return x

        self.first = grown(self.first, self.n, self.used + np.cumsum(counts) - counts)
        self.count = grown(self.count, self.n, counts)
        self.ids = grown(self.ids, self.used, ids)
        entry = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n, self.used = self.n + len(h), self.used + len(ids)
        at, slot = np.arange(len(h)), self._slots(h)
        while len(at):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = h[at[free]]  # where several claim a slot, one gets it
            won = np.zeros(len(at), bool)
            won[free] = self.keys[slot[free]] == h[at[free]]
            self.entry[slot[won]] = entry[at[won]]
            at, slot = at[~won], (slot[~won] + 1) & (SLOTS - 1)

    def _learn(self, raw: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, single: np.ndarray) -> None:
        """Entries of the pieces a..b."""
        order = np.argsort(~single, kind="stable")
        h, a, b, plain = h[order], a[order], b[order], int(single.sum())
        size = (b - a)[:plain]
        ends = np.cumsum(size)
        line = raw[np.repeat(a[:plain] - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
        words = [line[x:y] for x, y in zip((ends - size).tolist(), ends.tolist(), strict=True)]
        per, odd = [1] * plain, {}
        for k in range(plain, len(h)):
            piece = raw[a[k] : b[k]].tobytes().decode("utf-8", "replace")
            own = self.odd_ids(piece)
            found = self.find(piece) if own is None else []
            if not found:
                odd[k] = np.zeros(0, np.uint32) if own is None else own
            words += [w.encode() for w in found]
            per.append(len(found))
        ids, number = self.word_ids(words)
        sums = np.concatenate([[0], np.cumsum(number)])
        upto = np.cumsum(per)
        counts = sums[upto] - sums[upto - per]
        known = np.ones(len(h), bool)
        known[list(odd)] = False
        self._add(h[known], counts[known], ids)
        if odd:
            self._add(h[~known], np.array([len(x) for x in odd.values()]), np.concatenate(list(odd.values())))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of UTF-8 text, and the place in them where each row's ids end."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, single = pieces(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        h = piece_hashes(raw, starts, ends)
        h[h == 0] = 1
        out, counts = [], []
        for i in range(0, len(h), STEP):
            own = h[i : i + STEP]
            entry = self._look_up(own)
            new = np.flatnonzero(entry < 0)
            if len(new):
                if self.n + len(new) > self.most or self.used > MOST_IDS:
                    self._forget()
                    new = np.arange(len(own))
                _, one = np.unique(own[new], return_index=True)
                k = new[one]
                self._learn(raw, own[k], starts[i + k], ends[i + k], single[i + k])
                entry[new] = self._look_up(own[new])
            n, first = self.count[entry], self.first[entry]
            total = np.cumsum(n)
            out.append(self.ids[np.repeat(first - (total - n), n) + np.arange(int(total[-1]))])
            counts.append(n)
        ids, sums = np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        upto = sums[np.searchsorted(starts, offsets)]
        return ids, upto[1:]


class WordEncoder(PieceMemory):
    """Encodes whole texts as the tokenizers library does.

    New words go to the library's model many at once, one a line; the byte lengths of tokens tell
    which ids belong to which word. Texts that hold an added token go to the library whole, which
    matches these before it looks for words.
    """

    def __init__(self, tokenizer_path: str, most: int = 800_000):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(public_tokenizers.PATTERN, most)
        self.tok = Tokenizer.from_file(tokenizer_path)
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.added = [x.content.encode() for x in self.tok.get_added_tokens_decoder().values()]
        self.chars = byte_chars()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.length[i] = len(token)

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got, number = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 8192):
            some = words[i : i + 8192]
            ends = np.cumsum([len(x) for x in some])
            line = b"".join(some).decode("latin1").translate(self.chars)
            lines = "\n".join([line[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)])
            ids = np.array(self.model.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            got.append(ids)
            number.append(np.diff(np.searchsorted(np.cumsum(self.length[ids]), ends) + 1, prepend=0))
        return np.concatenate(got), np.concatenate(number)

    def odd_ids(self, piece: str) -> np.ndarray | None:
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, np.uint32) if ODD.search(piece) else None

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, ends = super().encode(raw, offsets)
        whole = self._with_added(raw, offsets)
        if whole:
            parts = [whole.get(k, ids[x:y]) for k, (x, y) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))]
            return np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends

    def _with_added(self, raw: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Ids, from the library, of the rows that hold an added token's text."""
        data, found = raw.tobytes(), {}
        for x in self.added:
            at = data.find(x)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                if k not in found and at + len(x) <= offsets[k + 1]:
                    text = data[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")
                    found[k] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
                at = data.find(x, int(offsets[k + 1]) if k in found else at + 1)
        return found


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each row's ids."""
    if end_id is None:
        return ids, ends
    n = np.diff(ends, prepend=0)
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, ends + np.arange(1, len(n) + 1)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer_path: str) -> WordEncoder:
    """One for each Python worker, which outlives a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]
