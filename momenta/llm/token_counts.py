"""Token counts through a compiled finite-state tokenizer.

A byte-pair tokenizer that always merges the best-ranked pair, leftmost first, gives a sequence of pieces in which
every two neighbours are what the tokenizer makes of the two joined; and any sequence of which that holds is the
tokenizer's. So the last piece of a prefix is decided by the last pieces of the prefixes before it, as far back as a
piece can reach, and reading a character is a step of a deterministic transducer: a state is, for every earlier place
from which a piece may still grow, the path so far, the piece before that place and the tokens there less the tokens
here. A transition emits the change in the number of tokens. States and transitions are compiled when first met.

No piece goes on over a space behind a non-space, so there every state leads to the same one. A chunk of a text, whose
first state isn't known, has a state map: for each state that its first characters may leave, the tokens of the rest
and the state at its end. The first characters are few (up to the first such boundary, or LEAD); they are kept, and
read when the chunk before is known. Maps compose associatively and stay as small as one chunk's, whatever they span;
long texts are cut into chunks for different tasks, and the maps are composed by a tree of aggregations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.llm.common import saved

#: Characters of a chunk; texts beyond are counted by several tasks.
CHUNK = 1 << 16
LIMIT = 4096
SPACE = "▁"
#: First characters of a map, behind which the states that the chunk before may leave have met but for their phase; the
#: phases that are tried, characters that the runs go on before those that have met are put together, and maps that
#: one task composes.
LEAD = 512
PHASES = 16
MEET = 4096
FAN = 64
#: States that a task keeps compiled, words whose counts it remembers, and the characters of such a word.
MAX_STATES = 1 << 18
MAX_WORDS = 1 << 19
MAX_WORD = 64

_NEVER = float("inf")
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Transducer:
    """pieces: text -> rank (low merges first); a character that is no piece counts unknown(character) tokens.

    State 0 is a word's start. count() reads a word and returns its tokens.
    """

    def __init__(self, pieces: dict[str, int], unknown=lambda c: len(c.encode("utf-8", "surrogatepass"))):
        self.pieces, self.unknown = pieces, unknown
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p))}
        self.merge_memo: dict[str, tuple] = {}
        self.clear()

    def clear(self) -> None:
        self.merge_memo.clear()
        #: Of a state: the starts from which a piece may still grow, as (path, piece before, tokens there - tokens here), longest first.
        self.states: list[tuple] = [(("", "", 0),)]
        self.number = {self.states[0]: 0}
        #: Transitions of a state: character -> (state, emitted tokens).
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def merges(self, piece: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The parts that the rule (merge the best-ranked pair, leftmost first) leaves, and of each merge its rank and the first and last parts after it."""
        parts, made = list(piece), [(-_NEVER, piece[0], piece[-1])]
        while len(parts) > 1:
            rank, i = min((self.pieces.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            made.append((rank, parts[0], parts[-1]))
        return parts, [*made, (_NEVER, "", "")]

    def fits(self, before: str, piece: str) -> bool:
        """Whether the tokenizer leaves the two pieces as they are; before is empty at a word's start.

        The merges inside the two go on as if each were alone, best rank first, unless one joins their facing parts.
        """
        parts, right = self.merge_memo.get(piece) or self.merge_memo.setdefault(piece, self.merges(piece))
        if len(parts) > 1:
            return False
        if not before:
            return True
        _, left = self.merge_memo.get(before) or self.merge_memo.setdefault(before, self.merges(before))
        i = j = 0
        while True:
            across = self.pieces.get(left[i][2] + right[j][1], _NEVER)
            a, b = left[i + 1][0], right[j + 1][0]
            if across < a and across <= b:
                return False
            if a == b == _NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def step(self, state: int, c: str) -> tuple[int, int]:
        """The next state and the tokens emitted on reading c."""
        last = None
        grown = []
        for path, before, tokens in self.states[state]:
            whole = path + c
            if last is None and (whole in self.pieces or not path) and self.fits(before, whole):
                # a character of its own is a token, or bytes if it is no piece
                last, now = whole, tokens + (1 if whole in self.pieces else self.unknown(c))
            if whole in self.prefixes:
                grown.append((whole, before, tokens))
        # one start is always right: the tokenizer has a piece that ends here
        following = tuple((p, b, t - now) for p, b, t in grown) + (("", last, 0),)
        at = self.number.get(following)
        if at is None:
            at = self.number[following] = len(self.states)
            self.states.append(following)
            self.steps.append({})
        self.steps[state][c] = (at, now)
        return at, now

    def run(self, word: str, state: int = 0) -> tuple[int, int]:
        """The state after word and the tokens emitted, from a state on."""
        steps, total = self.steps, 0
        for c in word:
            to = steps[state].get(c)
            state, n = to or self.step(state, c)
            total += n
        return state, total

    def count(self, word: str) -> int:
        return self.go_on(self.states[0], word)[1]

    def go_on(self, state: tuple, text: str) -> tuple[tuple, int]:
        """run() from and to a state's own value, which any process understands."""
        if len(self.states) > MAX_STATES:
            self.clear()
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        at, n = self.run(text, at)
        return self.states[at], n


class WordCounts(dict):
    """Tokens of whole words, from the transducer when first met."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(word) > MAX_WORD:
            return self.transducer.count(word)
        if len(self) > MAX_WORDS:
            self.clear()
        n = self[word] = self.transducer.count(word)
        return n


def load(model: str) -> WordCounts:
    """Compiles a sentencepiece byte-pair model with byte fallback, an identity normalizer and a space before the text."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(model, "rb") as f:
        m.ParseFromString(f.read())
    n, t = m.normalizer_spec, m.trainer_spec
    if not (t.model_type == 2 and t.byte_fallback and n.escape_whitespaces and n.add_dummy_prefix and not n.remove_extra_whitespaces and not n.precompiled_charsmap):
        raise ValueError(f"{model}: only byte-pair models with byte fallback, a space in front and no other normalization are compiled")
    normal = [p for p in m.pieces if p.type == 1]
    if len(normal) != sum(p.type not in (2, 3, 6) for p in m.pieces):
        raise ValueError(f"{model}: user-defined and unused pieces are not compiled")
    if any(SPACE in p.piece.lstrip(SPACE) for p in normal):
        raise ValueError(f"{model}: a piece goes on over a space, so words are no boundaries")
    return WordCounts(Transducer({p.piece: -p.score for p in normal}))


#: Where reading stands: whether the last character is a blank, and the transducer's state in the open word.
Place = tuple[bool, tuple]
START: Place = (True, (("", "", 0),))
#: A place in front of a boundary: any, as the next character is a blank behind a non-blank.
ANY = None
#: A chunk's map: its first characters, and for each place that they may leave the tokens of the rest and the place at its
#: end. A short chunk is all first characters and has no rest. A rest without entries is broken: the chunk before leaves
#: a place that was not foreseen.
Map = tuple[str, tuple[tuple[Place | None, int, Place], ...] | None]
_BOUNDARY = re.compile(f"[^{SPACE}](?={SPACE})")


def advance(at: Place | None, text: str, counts: WordCounts) -> tuple[Place, int]:
    """The place behind text (SPACE for blanks) and the tokens emitted, from a place on."""
    words = _WORDS.findall(text)
    if not words:
        return at, 0
    blank, state = at or (False, START[1])
    if words[0][0] == SPACE and not blank:
        state = START[1]
    go_on = counts.transducer.go_on
    state, total = go_on(state, words[0])
    if len(words) > 1:
        total += sum(map(counts.__getitem__, words[1:-1]))
        state, n = go_on(START[1], words[-1])
        total += n
    return (text[-1] == SPACE, state), total


def chunk_map(chunk: str, counts: WordCounts, lead: int = LEAD) -> Map:
    """The map of a chunk (SPACE for blanks). Without a boundary in its first characters, the places are those that are
    left by them when begun one, two, ... characters later: texts that repeat a short pattern differ by such a phase."""
    m = _BOUNDARY.search(chunk, 0, lead + 1)
    if m:
        end, n = advance(ANY, chunk[m.end() :], counts)
        return chunk[: m.end()], ((ANY, n, end),)
    if len(chunk) <= lead:
        return chunk, None
    head, rest = chunk[:lead], chunk[lead:]
    entries = [*{advance(START, head[k:], counts)[0] for k in range(min(PHASES, lead))}]
    # runs from several places meet: from there on they are one, with different tokens so far
    runs = {e: [(e, 0)] for e in entries}
    k = 0
    while k < len(rest):
        met: dict[Place, list[tuple[Place, int]]] = {}
        upto = k + MEET if len(runs) > 1 else len(rest)
        for at, who in runs.items():
            to, n = advance(at, rest[k:upto], counts)
            met.setdefault(to, []).extend((e, t + n) for e, t in who)
        runs, k = met, upto
    return head, tuple((e, t, to) for to, who in runs.items() for e, t in who)


def _onward(rest, at: Place) -> tuple[int, Place] | None:
    return next(((n, to) for e, n, to in rest if e is ANY or e == at), None)


def _joined(first, rest):
    """The entries of first whose ends the entries of rest go on from."""
    return tuple((e, n + more[0], more[1]) for e, n, to in first if (more := _onward(rest, to)))


def compose(a: Map, b: Map, counts: WordCounts, lead: int = LEAD) -> Map:
    """The map of a's chunk followed by b's."""
    (ha, ra), (hb, rb) = a, b
    if ra is None:
        head, first = chunk_map(ha + hb, counts, lead)
        return (head, first) if rb is None else (head, rb if first is None else _joined(first, rb))
    read = tuple((e, n + m, to) for e, n, at in ra for to, m in [advance(at, hb, counts)])
    return ha, read if rb is None else _joined(read, rb)


def finish(m: Map, counts: WordCounts) -> int | None:
    """The tokens of a whole text, or None for a broken map."""
    head, rest = m
    at, n = advance(START, head, counts)
    if rest is None:
        return n
    more = _onward(rest, at)
    return None if more is None else n + more[0]


def scan(maps: list[Map], counts: WordCounts) -> list[Map]:
    """Inclusive prefix scan, by doubling: log2(n) rounds of independent compositions."""
    out, k = list(maps), 1
    while k < len(out):
        out = out[:k] + [compose(a, b, counts) for a, b in zip(out, out[k:], strict=False)]
        k *= 2
    return out


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def _escaped(text: str) -> str:
    return text.replace(" ", SPACE)


def text_tokens(text: str | None, counts: WordCounts) -> int:
    return sum(map(counts.__getitem__, _WORDS.findall(SPACE + _escaped(text)))) if text else 0


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text; other columns are not read).

    n_tokens is what the model's library gives for the whole text, without begin, end or other added tokens. A null or
    empty text has none. Texts of more than `chunk` characters are cut into chunks, mapped by different tasks and put
    together by a scan. Rows that repeat a doc_id each come back. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = load_once(model)
        for batch in batches:
            n = np.fromiter((text_tokens(t, counts) for t in batch["text"].to_pylist()), np.int64, len(batch))
            yield pa.record_batch([batch["doc_id"], batch["n_bytes"], pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long")
    long = _long_counts(rows.where(F.length("text") > chunk), model, chunk)
    return short.union(long).withColumn("over_limit", F.col("n_tokens") > limit)


_NAMES = ["row", "doc_id", "n_bytes", "k"]


def _together(model: str, lead: int):
    """Composes the maps of a group of neighbouring chunks: (row, doc_id, n_bytes, k, map, g) to one row, whose k is g."""

    def run(table: pa.Table) -> pa.Table:
        counts = load_once(model)
        table = table.sort_by("k")
        whole, *others = (_tuples(json.loads(m)) for m in table["map"].to_pylist())
        for m in others:
            whole = compose(whole, m, counts, lead)
        return pa.table([*(table[c][:1] for c in ("row", "doc_id", "n_bytes", "g")), [json.dumps(whole)]], [*_NAMES, "map"])

    return run


def _long_counts(rows: DataFrame, model: str, chunk: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of rows (doc_id, n_bytes, text) through the maps of chunks.

    A level composes the maps of FAN neighbouring chunks; there are as many levels as the longest possible text needs.
    Rows whose map breaks are read again with longer first characters, in the end with all.
    """
    cuts = F.sequence(F.lit(0), ((F.length("text") - 1) / chunk).cast("int"))
    parts = rows.withColumn("row", F.monotonically_increasing_id())
    parts = parts.select("row", "doc_id", "n_bytes", F.explode(F.transform(cuts, lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), k * chunk + 1, F.lit(chunk)).alias("part")))).alias("c"))
    left, lead, done = saved(parts.select("row", "doc_id", "n_bytes", "c.k", "c.part"), "chunks"), LEAD, []
    while True:

        def maps(batches: Iterator[pa.RecordBatch], lead=lead) -> Iterator[pa.RecordBatch]:
            counts = load_once(model)
            for batch in batches:
                found = [chunk_map(SPACE * (k == 0) + _escaped(t), counts, lead) for k, t in zip(batch["k"].to_pylist(), batch["part"].to_pylist(), strict=True)]
                yield pa.record_batch([*(batch[c] for c in _NAMES), pa.array(map(json.dumps, found), pa.string())], [*_NAMES, "map"])

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = load_once(model)
            for batch in batches:
                n = [finish(_tuples(json.loads(m)), counts) for m in batch["map"].to_pylist()]
                yield pa.record_batch([*(batch[c] for c in _NAMES[:3]), pa.array(n, pa.int64())], [*_NAMES[:3], "n_tokens"])

        state = left.repartition("row", "k").mapInArrow(maps, "row long, doc_id long, n_bytes long, k int, map string")
        most = (1 << 31) // chunk + 1
        while most > 1:
            state = state.withColumn("g", F.floor(F.col("k") / FAN).cast("int")).groupBy("row", "g").applyInArrow(_together(model, lead), state.schema)
            most = -(-most // FAN)
        found = saved(state.mapInArrow(ends, "row long, doc_id long, n_bytes long, n_tokens long"), "long-counts")
        done.append(found.where("n_tokens is not null").drop("row"))
        broken = found.where("n_tokens is null").select("row")
        if broken.isEmpty():
            return reduce(DataFrame.unionAll, done)
        left, lead = saved(left.join(broken, "row", "left_semi"), "chunks"), lead * 64


_loaded: dict[str, WordCounts] = {}


def load_once(model: str) -> WordCounts:
    """load(), once in a Python worker."""
    if model not in _loaded:
        _loaded[model] = load(model)
    return _loaded[model]
