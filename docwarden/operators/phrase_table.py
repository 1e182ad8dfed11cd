"""Blocked phrases from a table of any number of rows.

The rule set's own phrases are part of the plan; thousands would make it a plan of thousands of expressions and as many
scans of a text. Here a text is read once whatever the number of phrases. A worker has one trie of all phrases whose nodes are
marks in a table, by hash of the bytes that lead to them; all places of a block of text go down it side by side, in numpy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import SEVERITY_WEIGHT
from .detect import THREATS_TYPE, normalized

#: Characters of phrases that are shipped to the workers at a time.
TRIE_CHARS = 4_000_000
#: Findings, or bytes of texts, after which a worker hands over what it has found.
PIECE = 50_000

#: Places of a text that go down the trie side by side, and bytes of phrases that are put into it at once.
_BLOCK, _BUILD = 1 << 16, 1 << 20
#: The table of marks has two to four places a node, up to these bits of a hash; more nodes only make more places look promising.
_MARK_BITS = 25
_DEEPER, _ENDS = 1, 2

_FIELDS = ["start", "end", "phrase", "kind", "severity", "description"]
_DEFAULT = ("Blocked phrase detected: '", "'")
THREAT_FIELDS = ["threat_type", "severity", "pattern_matched", "description", "start", "end", "confidence"]
_TRIES: dict[str, tuple] = {}


class _Hash:
    """Hashes of 64 bits of any run of bytes, from sums over what stands before it."""

    def __init__(self, seed: int):
        numbers = np.random.default_rng(seed).integers(0, 1 << 64, 257, np.uint64)
        self.code, self.mix = numbers[:256], int(numbers[256]) | 1
        self.up = self.down = np.empty(0, np.uint64)

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and factors: the run of ``n`` bytes from ``i`` has the hash ``(sums[i + n] - sums[i]) * factors[i]``."""
        if len(self.up) < len(data):
            factor, n = 0x9E3779B97F4A7C15, max(2 * _BLOCK, len(data))
            self.up = np.cumprod(np.full(n, factor, np.uint64))
            self.down = np.cumprod(np.full(n, pow(factor, -1, 1 << 64), np.uint64)) * np.uint64(self.mix)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.up[: len(data)], out=sums[1:])
        return sums, self.down


def _padded(data: np.ndarray, more: int) -> np.ndarray:
    return np.concatenate([data, np.zeros(more + 8, np.uint8)])


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, one behind the other, and where each begins and the last ends."""
    raw = texts.cast(pa.large_binary())
    _, ends, data = raw.buffers()
    ends = np.frombuffer(ends, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


class _Trie:
    """All places where phrases stand in a text. Only the lengths that phrases have are levels of the trie."""

    def __init__(self, phrases: pa.Array):
        data, ends = _bytes_of(phrases)
        self.at, self.size = ends[:-1], np.append(np.diff(ends), 0)
        self.levels = np.unique(self.size[:-1]).tolist()
        self.longest = max(self.levels, default=0)
        self.data = _padded(data, self.longest)
        nodes = int(np.searchsorted(self.levels, self.size[:-1], "right").sum())
        bits = min((2 * nodes + 1).bit_length(), _MARK_BITS)
        self.shift = np.uint64(64 - bits)
        for seed in count():
            self.hash, self.marks = _Hash(seed), np.zeros(1 << bits, np.uint8)
            keys = self._filled()
            # Phrases by hash, the last one being none; where those of each beginning of a hash start.
            self.order = np.append(np.argsort(keys, kind="stable"), len(keys))
            self.keys = np.append(keys[self.order[:-1]], np.uint64(2**64 - 1))
            if (self.keys[1:-1] != self.keys[:-2]).all():
                break
        bits = max(1, len(keys).bit_length())
        self.key_shift = np.uint64(64 - bits)
        heads = (self.keys[:-1] >> self.key_shift).view(np.int64)
        self.first = np.append(0, np.cumsum(np.bincount(heads, minlength=1 << bits))[:-1]).astype(np.int32)

    def _filled(self) -> np.ndarray:
        """Marks each node as what it is; the hash of each phrase."""
        keys = np.empty(len(self.at), np.uint64)
        begin = 0
        while begin < len(self.at):
            end = max(begin + 1, int(np.searchsorted(self.at, self.at[begin] + _BUILD)))
            base = self.at[begin]
            sums, factors = self.hash.sums(self.data[base : self.at[end - 1] + self.size[end - 1]])
            longest_first = begin + np.argsort(-self.size[begin:end], kind="stable")
            sizes = -self.size[longest_first]
            for level in self.levels:
                deeper, here = np.searchsorted(sizes, [-level, -level + 1])
                if not here:
                    break
                at = self.at[longest_first[:here]] - base
                key = (sums[at + level] - sums[at]) * factors[at]
                node = (key >> self.shift).view(np.int64)
                self.marks[node[:deeper]] |= _DEEPER
                self.marks[node[deeper:]] |= _ENDS
                keys[longest_first[deeper:here]] = key[deeper:]
            begin = end
        return keys

    def places(self, data: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and numbers of phrases, for one block of ``data`` after the other; ``stops``: where the text of each byte ends."""
        n, data = len(data), _padded(data, self.longest)
        words, own = _words(data), _words(self.data)
        for begin in range(0, n if self.levels else 0, _BLOCK):
            end = min(n, begin + _BLOCK)
            sums, factors = self.hash.sums(data[begin : end + self.longest])
            place, before, factor = np.arange(end - begin), sums[: end - begin], factors[: end - begin]
            found: list[tuple] = []
            for level in self.levels:
                key = (sums[place + level] - before) * factor
                mark = self.marks[(key >> self.shift).view(np.int64)]
                ends = np.flatnonzero((mark & _ENDS).view(bool))
                found.append((place[ends], key[ends]))
                deeper = np.flatnonzero((mark & _DEEPER).view(bool))
                if not len(deeper):
                    break
                if len(deeper) < 0.9 * len(place):
                    place, before, factor = place[deeper], before[deeper], factor[deeper]
            size = np.repeat(self.levels[: len(found)], [len(x) for x, _ in found])
            place, key = (np.concatenate(x) for x in zip(*found, strict=True))
            at = self.first[(key >> self.key_shift).view(np.int64)]
            low = np.flatnonzero(self.keys[at] < key)
            while len(low):
                at[low] += 1
                low = low[self.keys[at[low]] < key[low]]
            phrase = self.order[at]
            place += begin
            good = np.flatnonzero((self.keys[at] == key) & (self.size[phrase] == size) & (place + size <= stops[place]))
            place, phrase, size = place[good], phrase[good], size[good]
            # Equal hashes are not yet equal bytes.
            same, some = np.ones(len(place), bool), np.arange(len(place))
            for step in range(0, self.longest, 8):
                some = some[size[some] > step]
                if not len(some):
                    break
                beyond = (8 * np.maximum(0, step + 8 - size[some])).astype(np.uint64)
                same[some] &= (words[place[some] + step] ^ own[self.at[phrase[some]] + step]) << beyond == 0
            yield place[same], phrase[same]


def _firsts(place: np.ndarray, phrase: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each phrase in each text, in order of place and phrase; ``text``: the text of each byte."""
    key = np.sort(phrase << 32 | place)
    owner, phrase = text[key & 0xFFFFFFFF], key >> 32
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (phrase[1:] != phrase[:-1])
    key = key[new]
    key = np.sort((key & 0xFFFFFFFF) << 32 | key >> 32)
    return key >> 32, key & 0xFFFFFFFF


class _Rules:
    """A trie of the phrases of rules, and the rules of each phrase."""

    def __init__(self, phrases: pa.Array):
        """``phrases``: of each rule, in order."""
        n = len(phrases)
        new = np.ones(n, bool)
        if n:
            new[1:] = pc.not_equal(phrases[1:], phrases[:-1]).to_numpy(zero_copy_only=False)
        self.first = np.flatnonzero(new)
        self.many = np.diff(np.append(self.first, n))
        own = phrases.take(pa.array(self.first))
        self.phrases = pa.DictionaryArray.from_arrays(pa.array((np.cumsum(new) - 1).astype(np.int32)), own)
        self.chars = pc.utf8_length(own).to_numpy(zero_copy_only=False)
        self.trie = _Trie(own)

    def found(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the texts with these bytes and ends: number of findings of each, and first character, end and rule of each finding."""
        lengths = np.diff(ends)
        text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        kept, more, held = [(np.empty(0, np.int64),) * 2], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _firsts(*(np.concatenate(x) for x in zip(*kept, *more, strict=True)), text)

        for x in self.trie.places(data, np.repeat(ends[1:], lengths)):
            more.append(x)
            held += len(x[0])
            if held > _BUILD + 2 * len(kept[0][0]):
                kept, more, held = [merged()], [], 0
        place, phrase = merged()
        goes_on = (data & 0xC0) == 0x80
        start = place - ends[text[place]]
        if goes_on.any():
            chars = np.append(0, np.cumsum(~goes_on))
            start = chars[place] - chars[ends[text[place]]]
        stop, many = start + self.chars[phrase], self.many[phrase]
        counts = np.bincount(text[place], weights=many, minlength=len(lengths)).astype(np.int64)
        rule = np.repeat(self.first[phrase], many)
        if len(rule) > len(phrase):
            rule += np.arange(len(rule)) - np.repeat(np.cumsum(many) - many, many)
            start, stop = np.repeat(start, many), np.repeat(stop, many)
        return counts, start, stop, rule


def _coded(rules: pa.Table | list[tuple]) -> pa.Table:
    """Rules ``phrase, kind, severity, description`` as a table with the few kinds and severities as Arrow dictionaries."""
    columns = rules.combine_chunks().columns if isinstance(rules, pa.Table) else [pa.array(x, pa.string()) for x in zip(*rules, strict=True)]
    phrase, kind, severity, description = columns
    return pa.table([phrase, kind.dictionary_encode(), severity.dictionary_encode(), description], names=_FIELDS[2:])


def _tries(key: str, parts: list[Broadcast]) -> tuple:
    """The phrases of a table's rules and the rules as coded Arrow columns, those of a phrase side by side; once per Python worker.

    The rules come in order, as tables or rows. One without a description has the default one.
    """
    if key not in _TRIES:
        _TRIES.clear()
        tables = [_coded(p.value) if isinstance(p.value, list) else p.value for p in parts]
        columns = pa.concat_tables(tables).unify_dictionaries().combine_chunks().columns
        phrase, kind, severity, description = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in columns)
        rules = _Rules(phrase)
        default = pc.binary_join_element_wise(_DEFAULT[0], phrase, _DEFAULT[1], "")
        told = default if description.null_count == len(description) else pc.coalesce(description, default)
        description = pa.DictionaryArray.from_arrays(pa.array(np.arange(len(told), dtype=np.int32)), told)
        _TRIES[key] = (rules, [rules.phrases, kind, severity, description])
        # What building took.
        pa.default_memory_pool().release_unused()
    return _TRIES[key]


def _found(texts: pa.Array, rules: _Rules, columns: list[pa.Array], most: int) -> Iterator[pa.Array]:
    """Findings of each text, in pieces of whole texts that are cut once ``most`` findings or bytes have come together."""
    data, ends = _bytes_of(texts)
    begin = 0
    while begin < len(texts):
        end = min(len(texts), int(np.searchsorted(ends, ends[begin] + most, "left")))
        end = max(end, begin + 1)
        base = ends[begin]
        counts, start, stop, rule = rules.found(data[base : ends[end]], ends[begin : end + 1] - base)
        upto = np.append(0, np.cumsum(counts))
        first = 0
        while first < len(counts):
            last = min(len(counts), max(first + 1, int(np.searchsorted(upto, upto[first] + most, "left"))))
            a, b = upto[first], upto[last]
            at = pa.array(rule[a:b])
            fields = [*(pa.array(x[a:b].astype(np.int32)) for x in (start, stop)), *(c.take(at) for c in columns)]
            yield pa.ListArray.from_arrays(pa.array((upto[first : last + 1] - a).astype(np.int32)), pa.StructArray.from_arrays(fields, _FIELDS))
            first = last
        begin = end


def _threats(found: pa.ListArray) -> pa.ListArray:
    """Findings as threats, in the order of that type's fields."""
    start, end, phrase, kind, severity, description = found.values.flatten()
    fields = [kind, severity, phrase, description, start, end, pa.array(np.ones(len(start)))]
    return pa.ListArray.from_arrays(found.offsets, pa.StructArray.from_arrays(fields, THREAT_FIELDS))


def _decoded(threats: pa.ListArray) -> pa.ListArray:
    fields = [x.dictionary_decode() if pa.types.is_dictionary(x.type) else x for x in threats.values.flatten()]
    return pa.ListArray.from_arrays(threats.offsets, pa.StructArray.from_arrays(fields, THREAT_FIELDS))


def _search(parts: list[Broadcast], tell: Callable[[pa.ListArray], pa.Array] | None, kind: str):
    key, tell = uuid.uuid4().hex, tell or _decoded

    @F.arrow_udf(kind)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # A batch of texts may hold many times its size in findings, so they leave in pieces.
        for texts in batches:
            for piece in _found(texts, *_tries(key, parts), PIECE):
                yield tell(_threats(piece))

    return found


def phrase_rules(table: DataFrame) -> DataFrame:
    """Rows ``phrase, threat_type, severity, description`` of a rules table that has ``phrase`` and any of the others.

    Phrases are lower-cased; without the others a rule is a critical instruction override, as a rule set's own phrases are.
    Empty phrases and unknown severities are left out, and rules that repeat count once.
    """
    have = {c.lower() for c in table.columns}
    phrase = F.lower("phrase")

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name).cast("string"), default) if name in have else default

    rows = table.select(
        phrase.alias("phrase"),
        given("threat_type", F.lit("instruction_override")).alias("threat_type"),
        F.lower(given("severity", F.lit("critical"))).alias("severity"),
        given("description", F.concat(F.lit(_DEFAULT[0]), phrase, F.lit(_DEFAULT[1]))).alias("description"),
    )
    return rows.where((F.length("phrase") > 0) & F.col("severity").isin(*SEVERITY_WEIGHT)).distinct()


def find_phrases(
    df: DataFrame,
    text_col: str,
    table: DataFrame,
    to: str = "threats",
    trie_chars: int = TRIE_CHARS,
    tell: Callable[[pa.ListArray], pa.Array] | None = None,
    tell_type: str = THREATS_TYPE,
) -> DataFrame:
    """``df`` with ``to``: the threats (``array<threat>``) of the phrases of ``table`` that stand in the normalized text.

    Each rule counts once per text, at its phrase's first place, also within words, as a rule set's own phrases do;
    in order of place, then phrase, kind, severity and description. A null text counts as empty. A column named ``to`` is replaced. The result can be handed to
    ``detect_injection`` as ``extra_threats``. Rules are configuration and are shipped to all workers, ``trie_chars`` characters at a time.

    Thousands of threats a text take longer to hand to Spark than to find. ``tell`` is what a worker makes of them where they are
    found: it gets the threats of some texts, with all their fields (strings as Arrow dictionaries), and returns as many values
    of the SQL type ``tell_type``, which are put into ``to`` instead.
    """
    order = ["phrase", "threat_type", "severity", "description"]
    rules = phrase_rules(table).orderBy(*order)
    # What a default description says is not shipped.
    default = F.concat(F.lit(_DEFAULT[0]), F.col("phrase"), F.lit(_DEFAULT[1]))
    told = rules.withColumn("description", F.nullif("description", default)).toArrow()
    chars = np.cumsum(pc.utf8_length(told["phrase"]).to_numpy()) if len(told) else np.empty(0, np.int64)
    cuts = np.flatnonzero(np.diff(chars // trie_chars)) + 1
    context = df.sparkSession.sparkContext
    parts = [context.broadcast(_coded(told.slice(a, b - a))) for a, b in zip([0, *cuts], [*cuts, len(told)], strict=True)]
    norm = "__norm"
    out = df.withColumn(norm, normalized(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumn(to, _search(parts, tell, tell_type)(F.col(norm))).drop(norm)
