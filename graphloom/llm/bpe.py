"""Byte-pair encoding as a bounded-lookahead streaming transducer.

The merge list alone fixes how far the tokens of a prefix can still change when
more bytes follow: a merge can only be undone by a competing merge of lower
rank that starts on its right edge, that one by a still lower one further
right, and so on. ``MergeTable.lookahead`` is the longest such chain, in bytes.
A token is emitted as soon as that many bytes are known behind it, so a word of
any length is encoded in constant memory; a word shorter than the lookahead is
stable only at its end, and what it then emits is remembered. Decoding feeds the
tokens' bytes to one incremental UTF-8 state machine for the whole text. A text is
read in blocks; digests take the ids and the decoded text of each block as they
come, and nothing else of the text is kept.

Defined results: a null text counts as empty; an empty text has no tokens and
decodes to the empty string; repeated rows each give their own row; a null
``doc_id`` is carried through, and ids may be of any type; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Memo, map_batches, model

_SHIFT, _NONE = 20, 1 << 60
#: Bytes handed to the transducer at a time when a word is very long.
_FEED = 1024
#: Characters read at a time.
_SLICE = 1 << 16
#: Words of up to this many symbols are merged by plain scans.
_SHORT = 40


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class MergeTable:
    """Vocabulary and ranked merges of a byte-level BPE model with an optional end-of-word suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.suffix = suffix
        chars = byte_chars()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + suffix] for c in chars]
        self.shown = {i: t.encode() for t, i in vocab.items()}
        self.pairs: dict[int, int] = {}
        made: dict[int, list[tuple[int, int, int]]] = {}
        length = {i: len(t.removesuffix(suffix) if suffix else t) for t, i in vocab.items()}
        cut = len(suffix)
        for rank, (a, b) in enumerate(merges):
            left, right = vocab[a], vocab[b]
            new = vocab[(a[: len(a) - cut] if cut and a.endswith(suffix) else a) + b]
            self.pairs.setdefault(left << _SHIFT | right, rank << _SHIFT | new)
            made.setdefault(new, []).append((left, right, rank))
        self.longest = max(length.values())
        self.lookahead = self._lookahead(made, length)
        to_byte = {c: b for b, c in enumerate(chars)}
        self.token_bytes = {i: bytes(to_byte[c] for c in (t.removesuffix(suffix) if suffix else t)) for t, i in vocab.items() if set(t.removesuffix(suffix) if suffix else t) <= to_byte.keys()}

    @staticmethod
    def _lookahead(made: dict[int, list[tuple[int, int, int]]], length: dict[int, int]) -> int:
        """Longest chain of ever lower-ranked competitors along right edges, in bytes.

        Rules are taken in rank order; for the symbols down the right edge of a
        rule's right part, only rules that rank before the edge's own merge can
        take the symbol away, and each reaches as far as its right part plus
        what can in turn undo it. A symbol that several rules make has as many
        right edges.
        """
        by_left: dict[int, tuple[list[int], list[int]]] = {}
        most = 0
        for rank, left, right in sorted((rank, left, right) for rules in made.values() for left, right, rank in rules):
            reach, edges = 0, [(right, rank)]
            while edges:
                at, consumer = edges.pop()
                ranks, best = by_left.get(at, ((), ()))
                if (k := bisect_left(ranks, consumer)) > 0:
                    reach = max(reach, best[k - 1])
                edges += [(inner, earlier) for _, inner, earlier in made.get(at, ())]
            reach += length[right]
            ranks, best = by_left.setdefault(left, ([], []))
            ranks.append(rank)
            best.append(max(reach, best[-1]) if best else reach)
            most = max(most, reach)
        return most

    def merged(self, ids: list[int]) -> list[int]:
        if len(ids) > _SHORT:
            return self._merged_long(ids)
        get, mask, none = self.pairs.get, (1 << _SHIFT) - 1, _NONE
        ranks = [get(a << _SHIFT | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != none:
            i, new = ranks.index(low), low & mask
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << _SHIFT | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << _SHIFT | new, none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        get, mask, n = self.pairs.get, (1 << _SHIFT) - 1, len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << _SHIFT | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) < 0 or get(ids[i] << _SHIFT | ids[j], _NONE) != r:
                continue
            ids[i], ids[j] = r & mask, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(ids[i] << _SHIFT | ids[k], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << _SHIFT | ids[i], _NONE)) != _NONE:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]


class WordTransducer:
    """Encodes one word, fed in pieces; holds at most lookahead + one token + one piece."""

    def __init__(self, table: MergeTable) -> None:
        self.table, self.held = table, b""

    def feed(self, piece: bytes) -> Iterator[int]:
        self.held += piece
        t = self.table
        if len(self.held) <= t.lookahead + t.longest:
            return
        first, end, stable = t.first, 0, len(self.held) - t.lookahead
        for token in t.merged([first[b] for b in self.held]):
            if end + len(t.token_bytes[token]) > stable:
                break
            end += len(t.token_bytes[token])
            yield token
        self.held = self.held[end:]

    def finish(self) -> list[int]:
        t, held = self.table, self.held
        self.held = b""
        return t.merged([*(t.first[b] for b in held[:-1]), t.last[held[-1]]]) if held else []


class Decoder:
    """Incremental byte-to-text state machine: complete characters leave at once, at most 3 bytes stay.

    ``joined=True`` writes tokens as their vocabulary strings with one space
    between, which is what a tokenizer file without a decoder prescribes.
    """

    def __init__(self, table: MergeTable, special: dict[int, str], joined: bool) -> None:
        self.table, self.special, self.joined, self.shown = table, special, joined, table.shown
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, tokens: Iterable[int]) -> str:
        """The text that is complete once these tokens are read."""
        if self.joined:
            return self.feed_bytes([self.shown[t] for t in tokens])
        return "".join([self.state.decode(b"", True) + self.special[t] if t in self.special else self.state.decode(self.table.token_bytes[t]) for t in tokens])

    def feed_bytes(self, shown: list[bytes]) -> str:
        """The same for tokens given as what the vocabulary shows for them, one or several in each item."""
        if not shown:
            return ""
        begun, self.begun = self.begun, True
        return self.state.decode((b" " if begun else b"") + b" ".join(shown))

    def finish(self) -> str:
        self.begun = False
        return self.state.decode(b"", True)


#: What separates and classes characters in the supported files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Up to here all Unicode versions agree on letters and numbers; beyond, the
#: file's own splitter (not its BPE) classes the characters.
_PLAIN = "\u052f"
_CONTROL = "\x1c\x1d\x1e\x1f"  # white space to str.split(), not to the files' \s


class WordCodec:
    """The whole encoder and decoder for a file with NFC, white-space folding, lower-casing and word ends."""

    def __init__(self, spec: str, memo: int = 300_000) -> None:
        j = json.loads(spec)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]]
        self.table = MergeTable(j["model"]["vocab"], merges, j["model"]["end_of_word_suffix"] or "")
        self.special = {t["id"]: t["content"] for t in j["added_tokens"]}
        self.table.shown.update({i: t.encode() for i, t in self.special.items()})
        self.special_ids = {v: k for k, v in self.special.items()}
        self.splitter = regex.compile("(" + "|".join(regex.escape(x) for x in self.special_ids) + ")")
        self.find = regex.compile(WORD_PATTERN).findall
        self.space, self.gap = regex.compile(r"\s+").split, regex.compile(r"\s").search
        self.library = Tokenizer.from_str(spec)
        self.to_byte = {c: b for b, c in enumerate(byte_chars())}
        self.names = {i: str(i) for i in self.table.shown}
        self.words = Memo(self._word, memo)
        self.chunks = Memo(self._chunk, memo)

    def _tokens(self, tokens: Iterable[int]) -> tuple[str, bytes]:
        tokens = list(tokens)
        return " ".join(map(self.names.__getitem__, tokens)), b" ".join(map(self.table.shown.__getitem__, tokens))

    def _word(self, word: str) -> tuple[str, bytes]:
        raw, t = word.encode(), self.table
        if len(raw) <= t.lookahead:  # its end comes before anything is stable
            first = t.first
            return self._tokens(t.merged([*[first[b] for b in raw[:-1]], t.last[raw[-1]]]))
        return self._tokens(self.stream(raw))

    def stream(self, word: bytes) -> Iterator[int]:
        transducer = WordTransducer(self.table)
        for i in range(0, len(word), _FEED):
            yield from transducer.feed(word[i : i + _FEED])
        yield from transducer.finish()

    def _split(self, chunk: str) -> list[str]:
        """Words of a text without white space."""
        if max(chunk) > _PLAIN:
            shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            return [bytes(map(self.to_byte.__getitem__, x)).decode() for x, _ in shown]
        low = unicodedata.normalize("NFC", chunk)
        low = "".join(c.lower() for c in low) if "Σ" in low else low.lower()
        return self.find(low)

    def _chunk(self, chunk: str) -> tuple[str, bytes]:
        words = self._split(chunk)
        if len(words) == 1:
            return self.words[words[0]]
        found = [self.words[w] for w in words]
        return " ".join([ids for ids, _ in found]), b" ".join([shown for _, shown in found])

    def _chunks(self, text: str) -> Iterator[tuple[list[str], bool]]:
        """Texts without white space between them, some at a time, and whether one is very long."""
        at = 0
        while at < len(text):
            gap = self.gap(text, at + _SLICE) if len(text) - at > _SLICE else None
            part = text[at : gap.start() if gap else len(text)]
            at += len(part)
            # the file's white space is a little less than Python's
            chunks = [x for x in self.space(part) if x] if any(c in part for c in _CONTROL) else part.split()
            yield chunks, len(part) > _SLICE and max(map(len, chunks), default=0) > _SLICE

    def blocks(self, text: str) -> Iterator[tuple[list[str], list[bytes]]]:
        """Decimal ids, and what the vocabulary shows for them, of the text's parts one after the other."""
        for part in self.splitter.split(text) if "<|" in text else (text,):
            if part in self.special_ids:
                yield [str(self.special_ids[part])], [part.encode()]
                continue
            for chunks, any_long in self._chunks(part):
                for long, some in groupby(chunks, lambda x: len(x) > _SLICE) if any_long else ((False, chunks),):
                    if long:
                        for word in (w for x in some for w in self._split(x)):
                            yield from self._long(word.encode())
                    elif found := list(map(self.chunks.__getitem__, some)):
                        yield [ids for ids, _ in found], [shown for _, shown in found]
                self.trim()

    def _long(self, word: bytes) -> Iterator[tuple[list[str], list[bytes]]]:
        stream = self.stream(word)
        while tokens := list(islice(stream, _FEED)):
            ids, shown = self._tokens(tokens)
            yield [ids], [shown]

    def trim(self) -> None:
        for memo in (self.words, self.chunks):
            memo.trim()

    def encode(self, text: str) -> str:
        """Decimal ids, joined by one space."""
        return " ".join([ids for block, _ in self.blocks(text) for ids in block])

    def decode(self, ids: Iterable[int]) -> str:
        machine = Decoder(self.table, self.special, joined=True)
        return machine.feed(ids) + machine.finish()

    def round_trip(self, text: str, keep: list[tuple[str, str]] | None = None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of them and of the decoded text, in one pass; ``keep`` takes the blocks."""
        machine, n, of_ids, of_text = Decoder(self.table, self.special, joined=True), 0, hashlib.sha256(), hashlib.sha256()

        def out(ids: str, decoded: str) -> None:
            of_ids.update(ids.encode())
            of_text.update(decoded.encode())
            if keep is not None:
                keep.append((ids, decoded))

        for ids, shown in self.blocks(text):
            block = " ".join(ids)
            gap, n = " " if n else "", n + block.count(" ") + 1
            out(gap + block, machine.feed_bytes(shown))
        out("", machine.finish())
        return n, of_ids.hexdigest(), of_text.hexdigest()


def codec(spec: bytes) -> WordCodec:
    return model(("bpe", spec), lambda: WordCodec(spec.decode()))


def bpe_roundtrip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Encode and decode every whole text; no shuffle, one pass, and beside the texts themselves memory of one block.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, with
    ``texts=True``, ``ids array<int>`` and ``decoded string``. The tokenizer
    file, a few MB whatever the data, is broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, "rb").read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            made, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                keep = [] if texts else None
                made.append(c.round_trip(text or "", keep))
                if texts:
                    ids.append([int(x) for block, _ in keep for x in block.split()])
                    decoded.append("".join([x for _, x in keep]))
            counts, first, second = zip(*made, strict=True) if made else ((), (), ())
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, schema)
