"""Operator 13: SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding fills a table with one entry for each prefix of a stretch of text: the
last token of that prefix's encoding, which is unique. An automaton over the
vocabulary gives all tokens that end at a position; the one that is compatible
with the last token of the prefix before it (the two, encoded together, stay
two) is the entry. Ids are then recovered backwards from the last entry. This
is linear in the text, and equals the library's merging by priority: merges
are ordered by (score, leftmost), a merge that crosses the border of two final
tokens never had its turn, so the tokens before a border are the encoding of
the text before it, and compatibility of all neighbours fixes the whole.

Two tokens are compatible if undoing their last merges one after the other,
the latest first, never meets a pair at the border that would have been
merged before. Tokens whose parts do not all have higher scores than the whole
(runs of white space in many models, all of one score) are compared by running
the merges on the pair.

No token holds a white space mark after another character, so no merge
crosses from one word into the next mark: the stretches of the table are the
words with the marks before them. Some megabytes of texts are encoded
together: their distinct words are sorted, so that a word takes over the
table of the prefix it shares with the word before. Each worker keeps the
encodings of the words seen last (:data:`CACHE_WORDS` at most, in two halves of
which the older goes when the newer is full).

:class:`Codec` is built once on the driver from the vocabulary (its size is the
vocabulary's) and broadcast; each document is a row, nothing is shuffled.

Cases: a null text is encoded as the empty one (the end id only); ids may be
null or repeat, each row is answered alone; long texts are encoded whole,
memory is some ten times the text of a batch; characters without a piece become
their bytes' pieces (without those, the unknown id); ids of control pieces
decode to nothing; bytes that are no UTF-8 decode to one U+FFFD each; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm.common import fresh, table, without_collector

MARK = "▁"  # a space within a piece
CACHE_WORDS = 1 << 19
CACHED_LENGTH = 40  # longer stretches are not kept
STEP_CHARS = 4 << 20  # characters of texts that are encoded together, or one longer text
MAX_PAIRS = 1 << 19  # answers about pairs of tokens that are kept
MAX_STEPS = 1 << 20  # steps of the automaton that are kept besides the tree's
START = -(1 << 30)  # the token before a stretch
MODEL = "piece_bpe_32k.model"

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Codec:
    """Encoder and decoder of one merge-type model with identity normalisation.

    ``pieces``, ``scores``: by id; ``kinds``: by id, one of normal, control, unknown, byte, unused."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]) -> None:
        self.pieces, self.scores = pieces, scores
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == "normal"}
        byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.byte_ids = byte_ids if len(byte_ids) == 256 else None
        self.unknown = kinds.index("unknown")
        self.bytes = [self._plain(p, k) for p, k in zip(pieces, kinds, strict=True)]
        self.control = frozenset(i for i, k in enumerate(kinds) if k == "control")
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # The last merge of each token that merging its own characters gives; others never appear in an encoding.
        self.split: dict[int, tuple[int, int]] = {}
        self.simple: set[int] = set()
        tokens = []
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(p) == 1:
                self.simple.add(i)
                tokens.append(i)
                continue
            last = self._last_merge(p)
            if last is None:
                continue
            tokens.append(i)
            self.split[i] = last
            if all(x in self.simple and (len(pieces[x]) == 1 or scores[x] > scores[i]) for x in last if x >= 0) and min(last) >= 0:
                self.simple.add(i)
        self._build(tokens)
        self._newer: dict[str, list[int]] = {}
        self._older: dict[str, list[int]] = {}
        self.numerals = [str(i) for i in range(len(pieces))]

    def _build(self, tokens: list[int]) -> None:
        """The automaton of the tokens: per state the next states by character (completed while it runs), the state of
        the longest proper suffix, and the tokens that end there, longest first, each with the answers known so far
        to whether it may follow another one."""
        self.follows: dict[int, dict[int, bool]] = {i: {START: True} for i in tokens}
        go, ends = [{}], [()]
        for i in tokens:
            state = 0
            for ch in self.pieces[i]:
                nxt = go[state].get(ch)
                if nxt is None:
                    nxt = go[state][ch] = len(go)
                    go.append({})
                    ends.append(())
                state = nxt
            ends[state] = ((i, len(self.pieces[i]), self.follows[i]),)
        fail, queue = [0] * len(go), [*go[0].values()]
        for state in queue:  # by depth
            for ch, nxt in go[state].items():
                f = fail[state]
                while f and ch not in go[f]:
                    f = fail[f]
                fail[nxt] = go[f].get(ch, 0)
                ends[nxt] += ends[fail[nxt]]
                queue.append(nxt)
        self.go, self.fail, self.ends = go, fail, ends
        self.n_pairs = self.n_steps = 0

    def _step(self, state: int, ch: str) -> int:
        """The next state where it is not the tree's: found by suffixes, and kept."""
        f = state
        while f and ch not in self.go[f]:
            f = self.fail[f]
        nxt = self.go[f].get(ch, 0)
        if self.n_steps < MAX_STEPS:
            self.n_steps += 1
            self.go[state][ch] = nxt
        return nxt

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_newer": {}, "_older": {}}

    @staticmethod
    def _plain(piece: str, kind: str) -> bytes:
        if kind == "byte":
            return bytes([int(piece[3:5], 16)])
        return {"control": "", "unknown": " ⁇ "}.get(kind, piece.replace(MARK, " ")).encode()

    # -- merging by priority, for short strings only

    def _merged(self, chars: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Symbols left after all merges, and the two sides of the last one."""
        last = None
        while True:
            best, at = None, -1
            for k in range(len(chars) - 1):
                i = self.ids.get(chars[k] + chars[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return chars, last
            last = (chars[at], chars[at + 1])
            chars = [*chars[:at], chars[at] + chars[at + 1], *chars[at + 2:]]

    def _symbol(self, s: str) -> int:
        """Id of a symbol; a character without a piece has a negative one."""
        i = self.ids.get(s)
        return -1 - ord(s) if i is None else i

    def _text(self, i: int) -> str:
        return self.pieces[i] if i >= 0 else chr(-1 - i)

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        left, last = self._merged(list(piece))
        return (self._symbol(last[0]), self._symbol(last[1])) if len(left) == 1 else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when their texts are encoded together."""
        return self._undone(a, b) if a in self.simple and b in self.simple else self._run(a, b)

    def _learn(self, a: int, b: int) -> bool:
        """:meth:`compatible`, kept."""
        self.n_pairs += 1
        if self.n_pairs > MAX_PAIRS:
            for known in self.follows.values():
                known.clear()
                known[START] = True
            self.n_pairs = 1
        ok = self.follows[b][a] = self.compatible(a, b)
        return ok

    def _run(self, a: int, b: int) -> bool:
        x, y = self._text(a), self._text(b)
        return self._merged(list(x + y))[0] == [x, y]

    def _undone(self, a: int, b: int) -> bool:
        ids, pieces, scores, split = self.ids, self.pieces, self.scores, self.split
        # Of the merges undone so far: the latest on each side bounds what could have been merged at the border before.
        bound, strict = None, False
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None and (bound is None or scores[joined] > bound or (scores[joined] == bound and not strict)):
                return False
            left, right = split.get(a), split.get(b)
            if left is None and right is None:
                return True
            # The later of the two last merges is undone: the lower score; with equal scores the right one came later.
            if right is None or (left is not None and scores[a] < scores[b]):
                bound, strict, a = scores[a], True, left[1]  # a merge on the left of the border goes first at equal score
            else:
                bound, strict, b = scores[b], False, right[0]

    # -- encoding

    def _stretches(self, stretches: list[str]) -> Iterator[list[int]]:
        """Tokens of each stretch: the table of last tokens by prefix, read backwards. A character without a piece has a
        negative token. The table of a prefix that the stretch before had, too, is not filled again."""
        last, back, states, before_s = [START], [0], [0], ""
        go, ends = self.go, self.ends
        for s in stretches:
            n, same = len(s), 0
            for x, y in zip(s, before_s):  # noqa: B905 - to the end of the shorter
                if x != y:
                    break
                same += 1
            if len(last) <= n:
                more = n + 1 - len(last)
                last += [START] * more
                back += [0] * more
                states += [0] * more
            state, end = states[same], same
            for ch in s[same:] if same else s:
                end += 1
                nxt = go[state].get(ch)
                states[end] = state = self._step(state, ch) if nxt is None else nxt
                for i, k, known in ends[state]:
                    before = last[end - k]
                    ok = known.get(before)
                    if ok is None:
                        ok = self._learn(before, i)
                    if ok:
                        last[end], back[end] = i, k
                        break
                else:  # no token of the vocabulary ends there: the character by itself
                    last[end], back[end] = -1 - ord(ch), 1
            out = []
            while end:
                out.append(last[end])
                end -= back[end]
            out.reverse()
            before_s = s
            yield out

    def _with_bytes(self, tokens: list[int]) -> list[int]:
        if min(tokens) >= 0:
            return tokens
        out = []
        for t in tokens:
            if t >= 0:
                out.append(t)
            elif self.byte_ids is None:
                if not out or out[-1] != self.unknown:  # the library joins unknown neighbours
                    out.append(self.unknown)
            else:
                out += [self.byte_ids[b] for b in chr(-1 - t).encode("utf-8", "replace")]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without an end id."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= STEP_CHARS:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[list[int]]:
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        if not self.by_word or self.byte_ids is None:
            for m in marked:
                yield self._with_bytes(next(self._stretches([m]))) if m else []
            return
        words = [_STRETCH.findall(m) for m in marked]
        newer, older, known, new = self._newer, self._older, {}, []
        for w in set().union(*words):
            ids = newer.get(w)
            if ids is None:
                ids = older.get(w)
                if ids is None:
                    new.append(w)
                    continue
                newer[w] = ids
            known[w] = ids
        new.sort()
        for w, ids in zip(new, self._stretches(new), strict=True):
            known[w] = ids = self._with_bytes(ids)
            if len(w) <= CACHED_LENGTH:
                newer[w] = ids
        if len(newer) >= CACHE_WORDS // 2:
            self._newer, self._older = {}, newer
        for ws in words:
            yield list(chain.from_iterable(map(known.__getitem__, ws)))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; the space that encoding puts before a text is taken off again."""
        ids = [i for i in ids if i not in self.control] if not self.control.isdisjoint(ids := list(ids)) else ids
        if not ids:
            return ""
        got = b"".join(map(self.bytes.__getitem__, ids))
        if self.pieces[ids[0]].startswith(MARK):
            got = got[1:]
        return got.decode("utf-8", "each_byte")


_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def load(path: str) -> Codec:
    """The codec of a model file. Only models that merge and do not change the text are accepted."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    kinds = ["control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "normal" for i in range(n)]
    probe = " ﬁ①  Á\t　x "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError(f"{path}: the model changes texts before it merges, which this codec does not do")
    if "unused" in kinds:
        raise ValueError(f"{path}: unused pieces are not supported")
    return Codec([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds)


def encoded(docs: DataFrame, codec: Codec, text_col: str = "text", end_id: int = 2) -> DataFrame:
    """``docs`` with a struct ``pieces`` (n_tokens, ids array, decoded): ids end with ``end_id``, decoded is the text of the ids.

    For uses of the ids themselves; :func:`op13_sentencepiece` returns digests only."""
    spread = docs.sparkSession.sparkContext.broadcast(codec)

    @F.pandas_udf("n_tokens long, ids array<int>, decoded string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = spread.value
        for s in without_collector(batches):
            rows = [[*ids, end_id] for ids in own.encode_all(x or "" for x in s)]
            yield pd.DataFrame({"n_tokens": [len(r) for r in rows], "ids": [np.array(r, np.int32) for r in rows], "decoded": [own.decode(r) for r in rows]})

    return docs.withColumn("pieces", coded(F.col(text_col)))


def digests(docs: DataFrame, codec: Codec, text_col: str = "text", end_id: int = 2) -> DataFrame:
    """``docs`` without the text, with n_tokens, ids_sha256 and decoded_sha256."""
    spread = docs.sparkSession.sparkContext.broadcast(codec)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = spread.value
        for s in without_collector(batches):
            out = []
            for ids in own.encode_all(x or "" for x in s):
                ids.append(end_id)
                numbers = " ".join(map(own.numerals.__getitem__, ids))
                out.append((len(ids), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    work, made = fresh("pieces"), ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, *made)]
    return docs.select(*kept, digest(F.col(text_col)).alias(work)).select(*kept, *[f"{work}.{c}" for c in made])


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = load(public_tokenizers.path(MODEL))
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), codec)
