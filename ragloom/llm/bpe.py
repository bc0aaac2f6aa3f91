"""BPE encoding and decoding by tree concatenation.

A text is cut into halves, and these again, down to leaves of ``LEAF``
characters, wherever that falls.  Each leaf is split into words and encoded by
itself.  Where two sides meet, a window of words around the join is encoded
again, and grows until its first and last word agree exactly with the sides; a
word runs from where it begins on, so behind a word that both agree on the two
are the same.  Level by level the joins give the encoding of the whole.

A word above ``WORD`` characters is held as open tokens, not as a cached word:
its halves are encoded alike, and where two such stretches meet a window of
tokens is encoded again and grows until its first and last token agree with the
sides.  Neighbours are then pairwise compatible throughout, which makes the
sequence the encoding of the whole word.

Leaves of a text up to ``PART`` characters are encoded in the task that reads
it.  A longer text is dealt in parts, rows of their own, whose trees are built
in several tasks; one task then joins the parts.

Defined results: null and empty texts have no token and decode to the empty
string; repeated rows each get their row; special tokens in a text become their
ids, as the library does; clashing input columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle
import re
from array import array
from functools import partial
from itertools import groupby

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

LEAF, WORD, PART = 1024, 256, 1 << 16


class Merges:
    """The merge table of a BPE file: encodes a list of symbols."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[a, b] = i
        self.none = len(self.rank)
        self.end = model.get("end_of_word_suffix") or ""

    def encode(self, symbols: list[str]) -> list[str]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        if len(symbols) < 24:
            return self._encode_short(symbols)
        out, n = list(symbols), len(symbols)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank
        heap = [(rank[p], i, p) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if out[i] != pair[0] or j >= n or out[j] != pair[1]:
                continue  # a neighbour has changed since
            out[i], out[j], after[i] = pair[0] + pair[1], "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (out[a], out[b])) in rank:
                    heapq.heappush(heap, (rank[p], a, p))
        return [t for t in out if t]

    def _encode_short(self, symbols: list[str]) -> list[str]:
        """The same over plain lists; only the two pairs beside a merge are ranked anew."""
        out, get, none = list(symbols), self.rank.get, self.none
        ranks = [get(p, none) for p in zip(out, out[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            out[i] += out.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((out[i - 1], out[i]), none)
            if i < len(ranks):
                ranks[i] = get((out[i], out[i + 1]), none)
        return out

    def symbols(self, token: str) -> list[str]:
        """The single symbols that a token is made of."""
        if self.end and token.endswith(self.end):
            return [*token[: -len(self.end) - 1], token[-len(self.end) - 1 :]]
        return list(token)

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of two neighbours' text, from their own encodings; ``left`` is used up."""
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            window = self.encode([s for t in a + b for s in self.symbols(t)])
            whole_left, whole_right = k >= len(left), k >= len(right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                left[len(left) - len(a) :] = window
                left += right[len(b) :]
                return left
            k *= 2

    def tree(self, symbols: list[str], leaf: int = WORD) -> list[str]:
        """Encode leaves, then join neighbours level by level."""
        return fold([self.encode(symbols[s:e]) for s, e in leaves(len(symbols), leaf)], self.join)


def leaves(size: int, leaf: int) -> list[tuple[int, int]]:
    """(begin, end) of the leaves that halving makes of ``size`` until none is longer than ``leaf``."""
    n = 1
    while size > n * leaf:
        n *= 2
    return [(size * i // n, size * (i + 1) // n) for i in range(n)]


def fold(parts, join):
    """Join neighbours level by level, as the parts come; at most one part of each level waits."""
    held: list[tuple[int, object]] = []
    for part in parts:
        level = 0
        while held and held[-1][0] == level:
            part, level = join(held.pop()[1], part), level + 1
        held.append((level, part))
    whole = held.pop()[1]
    while held:
        whole = join(held.pop()[1], whole)
    return whole


class Node:
    """The encoding of a stretch of text: its words, and for each its ids and tokens, or open tokens (a list) if it is long."""

    __slots__ = ("text", "begin", "end", "words", "coded")

    def __init__(self, text: str, begin: int, end: int, split_words: list[str], coded: list):
        self.text, self.begin, self.end, self.words, self.coded = text, begin, end, split_words, coded

    def __getstate__(self):
        return self.text[self.begin : self.end], self.words, self.coded

    def __setstate__(self, state):
        self.text, self.words, self.coded = state
        self.begin, self.end = 0, len(self.text)


class WordBpe:
    """Ids and decoded text of the lower-casing word BPE file, as the library gives them."""

    def __init__(self, path: str, leaf: int = LEAF, word: int = WORD):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.normalizer, self.merges = Tokenizer.from_file(path).normalizer, Merges(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.any = regex.compile(split).findall
        self.alphabet = words.byte_alphabet()
        self.leaf, self.word = leaf, word
        self.kept = words.Kept(self._closed)
        self.joins = 0

    # -- words -------------------------------------------------------------------

    def _mapped(self, word: str) -> str:
        return word if word.isascii() and word.isalnum() else "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")])

    def _pack(self, tokens: list[str]) -> tuple[bytes, str]:
        """Packed ids, and the tokens with a space behind each."""
        vocab = self.merges.vocab
        return array("I", [vocab[t] for t in tokens]).tobytes(), "".join([t + " " for t in tokens])

    def _closed(self, word: str) -> tuple[bytes, str]:
        mapped = self._mapped(word)
        return self._pack(self.merges.encode([*mapped[:-1], mapped[-1] + self.merges.end]))

    def _open(self, word: str) -> list[str]:
        """Tokens of a stretch of a long word, without the mark of a word's end."""
        return self.merges.tree([*self._mapped(word)])

    def _close(self, tokens: list[str]) -> tuple[bytes, str]:
        """A long word's tokens once it is known to end: its last symbol is joined anew, with the mark."""
        last = tokens.pop()
        symbols = self.merges.symbols(last)
        inner = self.merges.encode(symbols[:-1]) if len(symbols) > 1 else []
        if inner:
            tokens = self.merges.join(tokens, inner) if tokens else inner
        ended = [symbols[-1] + self.merges.end]
        return self._pack(self.merges.join(tokens, ended) if tokens else ended)

    def _code(self, word: str):
        return self.kept[word] if len(word) <= self.word else self._open(word)

    # -- the tree ----------------------------------------------------------------

    def node(self, text: str) -> Node:
        """The encoding of a normalised text without special tokens."""
        find = words.WORD_PLAIN.findall if words.is_plain(text) else self.any
        recall, limit = self.kept.recall().__getitem__, self.word

        def leaf(begin: int, end: int) -> Node:
            found = find(text[begin:end])
            coded = list(map(recall, found)) if max(map(len, found), default=0) <= limit else [self._code(w) for w in found]
            return Node(text, begin, end, found, coded)

        return fold((leaf(s, e) for s, e in leaves(len(text), self.leaf)), partial(self.join, find=find))

    def join(self, left: Node, right: Node, find=None) -> Node:
        """One node of two neighbours; ``left`` is used up."""
        self.joins += 1
        find = find or self.any
        same = left.text is right.text
        text = left.text if same else left.text[left.begin : left.end] + right.text[right.begin : right.end]
        cut = left.end if same else left.end - left.begin
        begin, end = (left.begin, right.end) if same else (0, len(text))
        k = 2
        while left.words and right.words:
            a, b, ca, cb = left.words[-k:], right.words[:k], left.coded[-k:], right.coded[:k]
            s = e = cut
            for w in reversed(a):  # words hold no white space, so the last match before is the word
                s = text.rfind(w, begin, s)
            for w in b:
                e = text.find(w, e, end) + len(w)
            found = find(text[s:e])
            whole_left, whole_right = k >= len(left.words), k >= len(right.words)
            if (whole_left or found[0] == a[0]) and (whole_right or found[-1] == b[-1]):
                left.words[len(left.words) - len(a) :] = found
                left.coded[len(left.coded) - len(a) :] = self._again(found, a, b, ca, cb)
                left.words += right.words[len(b) :]
                left.coded += right.coded[len(cb) :]
                break
            k *= 2
        else:
            left.words += right.words
            left.coded += right.coded
        return Node(text, begin, end, left.words, left.coded)

    def _again(self, found: list[str], a: list[str], b: list[str], ca: list, cb: list) -> list:
        """The codes of a window's words, taken from the sides where these agree."""
        known, out = dict(zip(a + b, ca + cb, strict=True)), []
        for w in found:
            if len(w) <= self.word:
                out.append(self.kept[w])
            elif w == a[-1] + b[0]:
                left, right = (c if isinstance(c, list) else self._open(x) for x, c in ((a[-1], ca[-1]), (b[0], cb[0])))
                out.append(self.merges.join(left, right))
            else:
                out.append(known[w] if w in known else self._open(w))
        return out

    # -- texts -------------------------------------------------------------------

    def stretches(self, text: str) -> list[tuple[str, bool]]:
        """(normalised text, False) or (special token, True), in order."""
        out = []
        for part in self.split_special.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append((part, True))
            elif part:
                out.append((part.lower() if words.is_plain(part) else self.normalizer.normalize_str(part), False))
        return out

    def part(self, text: str, special: bool) -> Node:
        if special:
            return Node(text, 0, len(text), [text], [(array("I", [self.special[text]]).tobytes(), text + " ")])
        return self.node(text)

    def finish(self, coded: list) -> tuple[bytes, str]:
        """(packed ids, decoded text): tokens joined by single spaces, as this file has no decoder."""
        if any(type(c) is list for c in coded):
            coded = [self._close(c) if type(c) is list else c for c in coded]
        ids, tokens = zip(*coded, strict=True) if coded else ((), ())
        return b"".join(ids), "".join(tokens)[:-1]

    def __call__(self, text: str) -> tuple[bytes, str]:
        coded: list = []
        for t, special in self.stretches(text):
            coded += self.part(t, special).coded
        return self.finish(coded)


_CODERS: dict[tuple, WordBpe] = {}


def _coder(path: str, leaf: int) -> WordBpe:
    if (path, leaf) not in _CODERS:
        _CODERS[path, leaf] = WordBpe(path, leaf)
    return _CODERS[path, leaf]


def _output(found: list[tuple[bytes, str] | None], digests: bool) -> tuple[list, list[str]]:
    """The columns of encoded texts; None stays null."""
    each = lambda f, kind: pa.array([None if x is None else f(*x) for x in found], kind)
    counts = each(lambda ids, t: len(ids) // 4, pa.int64())
    if digests:
        return [counts, each(lambda ids, t: hashlib.sha256(ids).hexdigest(), pa.string()), each(lambda ids, t: hashlib.sha256(t.encode()).hexdigest(), pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]
    return [counts, each(lambda ids, t: array("I", ids).tolist(), pa.list_(pa.int64())), each(lambda ids, t: t, pa.string())], ["n_tokens", "ids", "decoded"]


def _encoded(batches, path: str, leaf: int, size: int, digests: bool):
    """Texts up to ``size`` encoded; of longer ones a row for each part, with its text."""
    code, rid = _coder(path, leaf), TaskContext.get().partitionId() << 33
    for b in batches:
        keys, rids, parts, special, texts, found = [], [], [], [], [], []
        for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if len(text or "") <= size:
                rows = [(None, None, None, code(text or ""))]
            else:
                cuts = [(t[s:e], x) for t, x in code.stretches(text) for s, e in leaves(len(t), size)]
                rows = [(i, x, t, None) for i, (t, x) in enumerate(cuts)]
            for i, x, t, done in rows:
                keys.append(key), rids.append(rid), parts.append(i), special.append(x), texts.append(t), found.append(done)
            rid += 1
        columns, names = _output(found, digests)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rids, pa.int64()), pa.array(parts, pa.int32()), pa.array(special, pa.bool_()), pa.array(texts, pa.string()), *columns], ["doc_id", "rid", "part", "special", "text", *names])


def _part_nodes(batches, path: str, leaf: int):
    code = _coder(path, leaf)
    for b in batches:
        nodes = [pickle.dumps(code.part(t, x)) for t, x in zip(b.column("text").to_pylist(), b.column("special").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "rid", "part", "special")), pa.array(nodes, pa.binary())], ["doc_id", "rid", "part", "special", "node"])


def _joined(batches, path: str, leaf: int, digests: bool):
    """Parts sorted by (rid, part) into whole texts."""
    code = _coder(path, leaf)

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "special", "node")), strict=True)

    for (_, key), text in groupby(rows(), key=lambda r: r[:2]):
        coded: list = []
        for special, stretch in groupby(text, key=lambda r: r[2]):  # special tokens stand between stretches of text
            nodes = (pickle.loads(r[3]) for r in stretch)
            coded += [c for n in nodes for c in n.coded] if special else fold(nodes, code.join).coded
        columns, names = _output([code.finish(coded)], digests)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *columns], ["doc_id", *names])


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", digests: bool = False, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """Per document: doc_id, n_tokens, and ids and decoded text, or their digests."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string")
    whole = rows.mapInArrow(partial(_encoded, path=tokenizer, leaf=leaf, size=part, digests=digests), f"doc_id long, rid long, part int, special boolean, text string, {out}")
    found = common.durable(whole, "bpe")
    done = found.where("part is null").drop("rid", "part", "special", "text")
    # parts of long texts: a number of partitions of its own keeps them in several tasks
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = found.where("part is not null").select("doc_id", "rid", "part", "special", "text").repartition(n, "rid", "part").mapInArrow(partial(_part_nodes, path=tokenizer, leaf=leaf), "doc_id long, rid long, part int, special boolean, node binary")
    joined = nodes.repartition("rid").sortWithinPartitions("rid", "part").mapInArrow(partial(_joined, path=tokenizer, leaf=leaf, digests=digests), f"doc_id long, {out}")
    return done.unionByName(joined)
