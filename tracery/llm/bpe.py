"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_bytes, doc_runs, lean, text_only
from .tokens import PieceMemory


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Reads bytes, writes token ids as soon as no other encoding is possible.

    The encoding of a text ends with the one token, among those that are suffixes of the text,
    that stands next to the last token of what is before it in an encoding of just these two. So
    all that later tokens depend on is, for each place from which a token may still be unfolding,
    the node of the token trie reached from there and the last token up to there. A state is that
    list. Each move gives the token that ends at its byte; once a state holds no place but the
    present one, what came before is settled and is written: the delay is at most the bytes for
    which longer tokens stay possible. Moves are worked out when first taken; ``most`` bounds the
    states remembered.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 250_000):
        self.ranks, self.most = ranks, most
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                child = self.next[node].get(b)
                if child is None:
                    child = self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = child
            self.token[node] = i
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.halves: dict[int, tuple | None] = {}
        self.open: dict[tuple[int, int | None], bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((0, None),)
        self.states, self.ids, self.moves = [start], {start: 0}, [{}]
        for x in (self.pairs, self.open):
            if len(x) > 4 * self.most:
                x.clear()

    def merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """Merges in order of rank, from the left, while more than ``least`` parts are left; with 1, this defines what the transducer has to give."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > least:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gave the token; None for a byte, () if merging its bytes gives something else."""
        got = self.halves.get(token, 0)
        if got == 0:
            own, got = self.bytes_of[token], None
            if len(own) > 1:
                parts = self.merged(own, 2)
                pair = [self.ranks.get(x, -1) for x in parts]
                got = tuple(pair) if len(parts) == 2 and b"".join(parts) == own and min(pair) >= 0 and self.merged(own) == [own] else ()
            self.halves[token] = got
        return got

    def _fits(self, last: int | None, token: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens.

        Goes back in time from the two: the merge that came last is undone, and at each step the
        tokens that then met at the border must not have had an earlier merge to make. Of equal
        merges the left one comes first.
        """
        key = (last, token)
        ok = self.pairs.get(key)
        if ok is not None:
            return ok
        ok, x, y, limit = self._halves(token) != (), last, token, 1 << 60
        while ok and last is not None:
            joint = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], limit)
            if joint < limit:
                ok = False
                break
            left, right = self._halves(x), self._halves(y)
            if not left and not right:
                break
            if left and (x > y or not right):
                x, limit = left[1], x
            else:
                y, limit = right[0], y + 1
        self.pairs[key] = ok
        return ok

    def _unfolds(self, node: int, last: int | None) -> bool:
        """Whether some token below the node could follow ``last``; taken as given where many tokens are below."""
        key = (node, last)
        ok = self.open.get(key)
        if ok is None:
            ok, below, seen = False, list(self.next[node].values()), 0
            while below and not ok:
                n = below.pop()
                seen += 1
                ok = seen > 24 or (self.token[n] >= 0 and self._fits(last, self.token[n]))
                below += self.next[n].values()
            self.open[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        alive, ended = [], None
        for node, last in self.states[state]:
            child = self.next[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if ended is None and token >= 0 and self._fits(last, token):
                ended = token
            if self.next[child] and self._unfolds(child, last):
                alive.append((child, last))
        alive.append((0, ended))
        new = tuple(alive)
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        move = self.moves[state][byte] = (to, ended)
        return move

    def _settled(self, ended: list[int]) -> list[int]:
        out, i = [], len(ended)
        while i:
            out.append(ended[i - 1])
            i -= len(self.bytes_of[ended[i - 1]])
        return out[::-1]

    def stream(self, data):
        """Ids of the bytes that an iterable gives, each as soon as it is settled."""
        state, ended = 0, []
        for b in data:
            state, token = self.moves[state].get(b) or self._move(state, b)
            ended.append(token)
            if len(self.states[state]) == 1:
                yield from self._settled(ended)
                ended.clear()
        yield from self._settled(ended)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern; a piece that is a token is that token, as in the library."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most:
            self._forget()
        moves, state, ended = self.moves, 0, []
        for b in piece:
            state, token = moves[state].get(b) or self._move(state, b)
            ended.append(token)
        return self._settled(ended)


# The bytes that a UTF-8 lead byte announces (0: not a lead byte).
LEAD = np.zeros(256, np.uint8)
LEAD[0x00:0x80] = 1
LEAD[0xC2:0xE0] = 2
LEAD[0xE0:0xF0] = 3
LEAD[0xF0:0xF5] = 4


class Utf8Machine:
    """Holds back the bytes of a character that is not whole yet."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> bytes:
        """All that is whole so far; what can no longer become a character passes unchanged."""
        data = self.held + data
        state = need = 0
        # only the last three bytes can belong to a character that is still open
        for k in range(max(0, len(data) - 3), len(data)):
            b = data[k]
            if need and b & 0xC0 == 0x80:
                need -= 1
            else:
                state, need = k, max(0, int(LEAD[b]) - 1)
        cut = state if need else len(data)
        self.held = data[cut:]
        return data[:cut]

    def end(self) -> bytes:
        out, self.held = self.held, b""
        return out


class Decoder:
    """Ids to bytes through one table of all token bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            of[i] = t
        self.table = np.frombuffer(b"".join(of), np.uint8)
        self.length = np.array([len(t) for t in of], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self.table[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()

    def stream(self, ids: np.ndarray, step: int = 4096):
        """Bytes in whole characters, step ids at a time."""
        machine = Utf8Machine()
        for i in range(0, len(ids), step):
            yield machine.feed(self.decode(ids[i : i + step]))
        yield machine.end()


class Codec(PieceMemory):
    """Whole texts to ids, with a bounded memory of what pieces encode to; new matches go through the transducer."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 800_000):
        super().__init__(pattern, most)
        ranks = read_ranks(ranks_path)
        self.transducer, self.decoder = Transducer(ranks), Decoder(ranks)

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.transducer.encode(w) for w in words]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null and empty texts have no ids, repeated and missing doc_ids stay as they are, an empty table gives none. No shuffle."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            for i, j in doc_runs(offsets):
                ids, ends = c.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "ids"])

    return text_only(docs).mapInArrow(lean(run), "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids)."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            data = [b"".join(c.decoder.stream(x.values.to_numpy())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.mapInArrow(lean(run), "doc_id bigint, data binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), encoding and decoding in one pass so that ids need not travel. Null texts count as empty; repeated and missing doc_ids stay as they are; an empty table gives none."""

    def run(batches):
        c = codec(ranks_path, pattern)
        decimal = Decoder({f"{i},".encode(): i for i in range(len(c.decoder.length))})
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            for i, j in doc_runs(offsets):
                ids, ends = c.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                written, sums = decimal.decode(ids), np.concatenate([[0], np.cumsum(decimal.length[ids])])
                a, b, begin = [], [], 0
                for end in ends.tolist():
                    a.append(hashlib.sha256(written[sums[begin] : max(sums[begin], sums[end] - 1)]).hexdigest())
                    h = hashlib.sha256()
                    for part in c.decoder.stream(ids[begin:end], 1 << 16):
                        h.update(part)
                    b.append(h.hexdigest())
                    begin = end
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(ends, prepend=0)), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_only(docs).mapInArrow(lean(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
