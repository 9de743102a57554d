"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed
into the longest phrases that occur in a language's labelled text; the language
that needs the fewest phrases for each letter, weighted by what pointing into
its labelled text costs, wins. Parsing runs over all texts of a batch at once:
the automata are one dense transition table, with a sorted list beside it for
letters beyond a language's ``DENSE`` commonest, and the texts are read in blocks
of ``BLOCK`` characters side by side. A block is first parsed as if a phrase
began with it; then the phrase left open before it is carried on, and from the
first place where both begin a phrase they agree. So every text is parsed whole.

Defined results: ``und`` with score 0 for a null text, one without a letter, or
when nothing was labelled; with one language known it wins with score 1; ties
go to the name that sorts first; repeated documents are judged alike; an id given
to several rows is learned from once a language; ids may be of any type; an empty
table gives an empty result; columns other than id, text and lang are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_bucket, map_batches, model

#: Bounds of the labelled sample: documents and characters for each language. Documents count whole.
SAMPLE_DOCS, SAMPLE_CHARS = 96, 32_768
#: Longer documents are sampled only after all others.
LONG = SAMPLE_CHARS // 8
#: Letters of a language with a column of their own in the dense table; transitions of its others are looked up in a sorted list.
DENSE = 60
#: Characters of a block; blocks (times languages) parsed side by side; characters held at a time.
BLOCK, SIDE, SLICE = 512, 16_384, 1 << 20
_SPACE, _OTHER, _PAD, _RARE = 0, 1, 2, 3
_PLANES = 0x110000


def suffix_automaton(codes: np.ndarray, width: int) -> tuple[np.ndarray, dict[int, dict[int, int]]]:
    """Transitions of the automaton of all substrings; state 0 is the root.

    Codes below ``width`` are columns of a table (states x width, -1 for none),
    the others keys of a dictionary for each state that has any.
    """
    n = len(codes)
    move = np.full((2 * n + 1, width), -1, dtype=np.int32)
    link, size, last, states = [-1] * (2 * n + 1), [0] * (2 * n + 1), 0, 1
    rows = move  # plain indexing below; Python lists would cost width times the memory
    more: dict[int, dict[int, int]] = {}

    def get(state: int, c: int) -> int:
        return int(rows[state, c]) if c < width else more.get(state, {}).get(c, -1)

    def put(state: int, c: int, to: int) -> None:
        if c < width:
            rows[state, c] = to
        else:
            more.setdefault(state, {})[c] = to

    for c in codes.tolist():
        new = states
        states += 1
        size[new] = size[last] + 1
        p = last
        while p >= 0 and get(p, c) < 0:
            put(p, c, new)
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = get(p, c)
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = states
                states += 1
                size[copy], link[copy] = size[p] + 1, link[q]
                rows[copy] = rows[q]
                if q in more:
                    more[copy] = dict(more[q])
                while p >= 0 and get(p, c) == q:
                    put(p, c, copy)
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return move[:states], more


class Alphabet:
    """Characters to classes: letters lower-cased, everything else one blank."""

    def __init__(self, letters: list[str]) -> None:
        self.width = len(letters) + 3
        table = np.full(_PLANES, _SPACE, dtype=np.int32)
        known = {c: k + 3 for k, c in enumerate(letters)}
        for cp in range(_PLANES):
            c = chr(cp)
            if c.isalpha():
                table[cp] = known.get(c.lower()[:1], _OTHER)
        self.table = table

    def codes(self, texts: list[str], after_blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts one behind the other, runs of blanks as one, and each text's end; ``after_blank``: the first goes on behind one."""
        ends = np.cumsum([len(t) for t in texts])
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.table[cp]
        blank = codes == _SPACE
        drop = np.zeros(len(codes), dtype=bool)
        drop[1:] = blank[1:] & blank[:-1]
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        drop[begins[begins < len(codes)]] = False
        if after_blank and len(codes) and blank[0]:
            drop[0] = True
        kept = np.concatenate([[0], np.cumsum(~drop)])
        return codes[~drop], kept[ends]


class Parser:
    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        letters = Counter(c for t in samples.values() for c in t.lower() if c.isalpha())
        self.alphabet = Alphabet([c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))])
        coded = [self.alphabet.codes([samples[name]])[0] for name in self.names]
        counts = [np.bincount(codes, minlength=self.alphabet.width) for codes in coded]
        own = [np.lexsort((np.arange(len(n) - 3), -n[3:]))[: np.count_nonzero(n[3:])] + 3 for n in counts]
        self.width = _RARE + 1 + min(DENSE, max(map(len, own), default=0))
        #: Column of each class in each language's part of the table.
        self.column = np.full((len(self.names), self.alphabet.width), _OTHER, dtype=np.int32)
        tables, keys, targets, self.roots, self.closed, self.cost, at = [], [], [], [], [], [], 0
        for j, codes in enumerate(coded):
            self.column[j, [_SPACE, _PAD]] = _SPACE, _PAD
            self.column[j, own[j][:DENSE]] = np.arange(min(DENSE, len(own[j]))) + _RARE + 1
            self.column[j, own[j][DENSE:]] = _RARE
            column = self.column[j][codes]
            move, more = suffix_automaton(np.where(column == _RARE, self.width + codes, column), self.width)
            move = np.concatenate([move, np.full((1, self.width), -1, dtype=np.int32)])  # no phrase is open
            move[:, _OTHER] = -1  # letters of which nothing is known match nowhere
            move[:, _PAD] = np.arange(len(move))
            move[move >= 0] += at
            tables.append(move.ravel())
            for state, found in more.items():
                for c, to in found.items():
                    keys.append((at + state) * self.alphabet.width + c - self.width)
                    targets.append(at + to)
            self.roots.append(at)
            self.closed.append(at + len(move) - 1)
            self.cost.append(math.log2(max(2, len(codes))))
            at += len(move)
        self.move = np.concatenate(tables) if tables else np.array([], dtype=np.int32)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.targets = np.array(keys, dtype=np.int64)[order], np.array(targets, dtype=np.int32)[order]

    def _to(self, state: np.ndarray, column: np.ndarray, c: np.ndarray) -> np.ndarray:
        """States reached from ``state`` (in units of the width) by classes ``c``, whose columns are given; -1 for none."""
        to = self.move[state + column]
        if len(self.keys) and len(rare := np.flatnonzero(column == _RARE)):
            key = (state[rare] // self.width) * self.alphabet.width + c[rare]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[rare] = np.where(self.keys[spot] == key, self.targets[spot], -1)
        return to

    def phrases(self, codes: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases each text needs in each language (texts x languages), and the last text's open phrases.

        ``before``: phrases (one a language) still open where the first text goes on.
        """
        k = len(self.names)
        begins = np.concatenate([[0], ends[:-1]])
        blocks = -(-(ends - begins) // BLOCK)
        owner = np.repeat(np.arange(len(ends)), blocks)
        start = begins[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        out = np.zeros((len(ends), k))
        last, of = before, 0 if before is not None else -1  # open phrases, and of which text
        side = max(1, SIDE // k)
        for low in range(0, len(owner), side):
            own = owner[low : low + side]
            goes_on = np.concatenate([[own[0] == of], own[1:] == own[:-1]])
            count, last = self._parse(codes, start[low : low + side], ends[own], goes_on, last)
            of = own[-1]
            for j in range(k):
                out[:, j] += np.bincount(own, weights=count[j], minlength=len(ends))
        if of != len(ends) - 1 or last is None:
            last = np.array(self.closed, dtype=np.int64) * self.width
        return out, last

    def _step(self, state: np.ndarray, column: np.ndarray, c: np.ndarray, root: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and where phrases begin; a letter that never occurs is one by itself."""
        to = self._to(state, column, c)
        miss = np.flatnonzero(to < 0)
        if len(miss):
            again = self._to(root[miss], column[miss], c[miss] if len(self.keys) else c)
            to[miss] = np.where(again < 0, closed[miss], again)
        return to.astype(np.int64) * self.width, miss

    def _parse(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray, goes_on: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block (languages x blocks), and the phrases open behind the last block.

        ``goes_on``: blocks that follow the block before them, the first one ``before``.
        """
        width, k, n = self.width, len(self.names), len(start)
        root = np.repeat(np.array(self.roots, dtype=np.int64) * width, n)
        closed = np.repeat(np.array(self.closed, dtype=np.int64), n)
        steps = int(min(BLOCK, (stop - start).max()))
        state, begun = closed * width, np.zeros((steps, k * n), dtype=bool)
        text = codes[np.minimum(start[None, :] + np.arange(steps)[:, None], len(codes) - 1)]
        text[start[None, :] + np.arange(steps)[:, None] >= stop[None, :]] = _PAD
        for step in range(steps):
            c = text[step]
            state, miss = self._step(state, self.column[:, c].ravel(), np.tile(c, k) if len(self.keys) else c, root, closed)
            begun[step, miss] = True
        count = begun.sum(axis=0, dtype=np.int64)
        # carry open phrases on, until they agree with what was parsed; again where a block's true end turns out another
        change, end = np.zeros(k * n, dtype=np.int64), state.copy()
        used = np.full(k * n, -1, dtype=np.int64)
        follows = np.tile(goes_on, k)
        while True:
            wanted = np.roll(end, 1)
            if before is not None:
                wanted[::n] = before
            todo = np.flatnonzero(follows & (wanted != used))
            if not len(todo):
                return (count + change).reshape(k, n), end[n - 1 :: n]
            used[todo] = now = wanted[todo]
            change[todo], end[todo] = 0, state[todo]
            language, block = todo // n, todo % n
            for step in range(steps):
                c = text[step, block]
                now, miss = self._step(now, self.column[language, c], c, root[todo], closed[todo])
                begins = np.zeros(len(todo), dtype=bool)
                begins[miss] = True
                already = begun[step, todo]
                change[todo] += begins.astype(np.int64) - already
                apart = ~(begins & already)
                if not apart.all():
                    todo, language, block, now = todo[apart], language[apart], block[apart], now[apart]
                    if not len(todo):
                        break
            end[todo] = now

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Texts are taken in slices of ``SLICE`` characters, so that memory does not depend on their length."""
        n, k = len(texts), len(self.names)
        if not k:
            return ["und"] * n, np.zeros(n)
        bits, letters = np.zeros((n, k)), np.zeros(n, dtype=np.int64)
        last, before, blank = -1, None, False
        for part in self._slices(texts):
            who = np.array([i for i, _ in part])
            on = who[0] == last
            codes, ends = self.alphabet.codes([t for _, t in part], on and blank)
            lettered = np.concatenate([[0], np.cumsum(codes != _SPACE)])
            np.add.at(letters, who, lettered[ends] - lettered[np.concatenate([[0], ends[:-1]])])
            count, before = self.phrases(codes, ends, before if on else None)
            np.add.at(bits, who, count)
            last, blank = who[-1], self.alphabet.table[ord(part[-1][1][-1])] == _SPACE
        bits *= np.array(self.cost)
        best = bits.argmin(axis=1)
        low = bits[np.arange(n), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if k > 1 else low
        score = second / np.maximum(low + second, 1e-9) if k > 1 else np.ones(n)
        none = letters == 0
        return ["und" if x else self.names[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, score)

    @staticmethod
    def _slices(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        part, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t or ""), SLICE):
                part.append((i, t[at : at + SLICE]))
                size += len(part[-1][1])
                if size >= SLICE:
                    yield part
                    part, size = [], 0
        if part:
            yield part


def sample(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2, most_docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text of each language: whole documents, at most ``most_docs``, in the order of their ids' hashes, while ``chars`` holds them.

    Documents over ``LONG`` characters come last, so that one cannot stand for a
    language; only where the first by itself exceeds ``chars``, its middle is taken.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(crc_bucket(id_col, modulus) != held, F.lit(False)))
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    order = F.struct((F.length("text") > LONG).alias("long"), F.xxhash64("id").alias("hash"), F.col("id"), F.length("text").alias("size"))
    heads = rows.select("lang", order.alias("at")).groupBy("lang", F.col("at.id").alias("id")).agg(F.min("at").alias("at"))
    # the first of each share of a language, then of these: few rows of a language meet in one task
    share = F.row_number().over(Window.partitionBy("lang", "share").orderBy("at"))
    heads = heads.withColumn("share", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(16))).withColumn("rank", share).where(F.col("rank") <= most_docs).select("lang", "id", "at")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    picked: dict[str, list] = {}
    room: dict[str, int] = {}
    for r in heads.withColumn("rank", rank).where(F.col("rank") <= most_docs).orderBy("lang", "rank").collect():
        left = room.setdefault(r.lang, chars)
        if r["at"]["size"] < left or r.lang not in picked:
            picked.setdefault(r.lang, []).append((r.id, r.lang, r["at"]["size"]))
            room[r.lang] = left - r["at"]["size"] - 1
    if not picked:
        return {}
    wanted = docs.sparkSession.createDataFrame([x for found in picked.values() for x in found], f"id {rows.schema['id'].dataType.simpleString()}, lang string, size int")
    some = rows.withColumn("size", F.length("text")).join(F.broadcast(wanted), ["id", "lang", "size"])
    cut = F.substring("text", F.greatest(F.lit(1), ((F.length("text") - chars) / 2).cast("int")), F.lit(chars))
    some = some.groupBy("lang", "id").agg(F.min_by(cut, F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in sorted(some.collect(), key=lambda r: (r.lang, r.id)):
        texts.setdefault(r.lang, []).append(r.text)
    return {lang: " ".join(parts) for lang, parts in texts.items()}


def _parser(samples: dict[str, str]) -> Parser:
    return model(("langid", tuple(sorted(samples.items()))), lambda: Parser(samples))


def with_language(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2, wanted: Collection[str] | None = None) -> DataFrame:
    """``docs`` without the rows whose language is ``und``, or not among the ``wanted`` ones if these are given; nothing is shuffled.

    A null ``lang_col`` is filled with the prediction, all other columns and
    values stay. Where no language is known, only null texts and those without a
    letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sample(docs, lang_col, id_col, text_col, modulus, held))
    good = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            if not shared.value:
                yield b.filter(pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()))
                continue
            names = _parser(shared.value).judge(texts)[0]
            at = b.schema.names.index(lang_col)
            filled = pc.coalesce(b.column(at), pa.array([None if x == "und" else x for x in names], pa.string()).cast(b.schema.field(at).type))
            keep = [x != "und" and (good is None or x in good) for x in names]
            yield b.set_column(at, b.schema.field(at), filled).filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def language_id(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2) -> DataFrame:
    """``id_col, held_out, lang_pred, score``: one pass, no shuffle of texts; a null id is not held out.

    ``score`` is the second-best language's cost over the sum of the two best,
    so 0.5 means undecided. The sample (bounded) is broadcast and every worker
    builds the automata once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sample(docs, lang_col, id_col, text_col, modulus, held))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = _parser(shared.value).judge(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    judged = map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, lang_pred string, score double")
    return judged.select(id_col, F.coalesce(crc_bucket(id_col, modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
