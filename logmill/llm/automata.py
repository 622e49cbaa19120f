"""Grammar inference: probabilistic automata by statistically compatible state merging.

The labelled strings make a prefix tree with visit and end counts. States are taken breadth first; one
is merged into an accepted state if the Hoeffding bound cannot tell apart their end and transition
shares, nor those of their successors (recursively); else it becomes an accepted state itself.

States branch by the class of a character, and each transition counts the characters themselves. So states
whose literals differ (a prefix that all credentials share, and the random part after it) are told apart by
the same bound, and a string is scored by its characters: the share of the class in its state times the share of
the character in the transition, which is smoothed towards an even share of the class by ``BACK_OFF`` visits. A
transition that has seen few characters says little about them, one that has always seen the same says much.

``learned`` makes the automata of sets of any size, of all their strings: the strings are sorted by range, so that a task
counts the nodes of its part of the tree one after the other, and hands on those that one in ``SHARE`` strings of the set
pass, two at least (and those that other tasks may have a part of). The driver merges these; a rarer node leads to the first
state, into which one that a single string passes is always merged. Then all strings go through the automaton, and its counts are theirs.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logmill.llm.common import arrow_schema

ALPHA = 0.05
#: A node of the tree that fewer than one in so many strings pass is no state of its own.
SHARE = 1_000
#: Nodes are told by the hash of their path, modulo a prime.
PRIME, BASE = (1 << 61) - 1, 1_186_039_717_211_438_221
NODES = "name string, node bigint, parent bigint, class string, ends bigint, chars string, counts array<bigint>"
COUNTS = "name string, state bigint, char string, n bigint"
#: Weight given to symbols and ends that a state has never seen.
UNSEEN = 1e-3
#: Visits that the even share of a class's characters counts for.
BACK_OFF = 5.0
#: Characters of each class; a sign is a class of its own.
SIZES = {"d": 10, "h": 6, "H": 6, "l": 20, "U": 20}


def symbols(text: str) -> str:
    """A character's class: digits, letters that hexadecimal uses and others, by case; signs stay."""
    return text.translate(_CLASS)


_CLASS = {ord(c): "d" for c in "0123456789"} | {ord(c): "h" for c in "abcdef"} | {ord(c): "H" for c in "ABCDEF"}
_CLASS |= {c: "l" for c in range(ord("g"), ord("z") + 1)} | {c: "U" for c in range(ord("G"), ord("Z") + 1)}


@dataclass
class State:
    visits: int = 0
    ends: int = 0
    to: dict[str, int] = field(default_factory=dict)
    times: dict[str, int] = field(default_factory=dict)
    #: by class: how often each character stood for it
    chars: dict[str, dict[str, int]] = field(default_factory=dict)

    def seen(self, c: str, char: str, n: int = 1) -> None:
        self.times[c] = self.times.get(c, 0) + n
        held = self.chars.setdefault(c, {})
        held[char] = held.get(char, 0) + n


def _differ(f1: int, n1: int, f2: int, n2: int) -> bool:
    return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (n1**-0.5 + n2**-0.5)


class Automaton:
    def __init__(self, strings: Iterable[str]):
        self.states = [State()]
        for text in strings:
            at = 0
            self.states[0].visits += 1
            for c, char in zip(symbols(text), text):
                s = self.states[at]
                s.seen(c, char)
                if c not in s.to:
                    s.to[c] = len(self.states)
                    self.states.append(State())
                at = s.to[c]
                self.states[at].visits += 1
            self.states[at].ends += 1
        self._merge()

    @classmethod
    def of_nodes(cls, nodes: Iterable[tuple], least: int) -> Automaton:
        """Of the nodes of a tree (``NODES`` without the name; a node may come in parts) that ``least`` strings pass."""
        states: dict[int, State] = {}
        places = {}
        for node, parent, c, ends, chars, counts in sorted(nodes):
            s = states.setdefault(node, State())
            places[node] = parent, c
            s.ends += ends
            for char, n in zip(chars, counts):
                s.seen(symbols(char), char, n)
        for s in states.values():
            s.visits = s.ends + sum(s.times.values())
            s.chars = {c: dict(sorted(held.items())) for c, held in s.chars.items()}
        root = next((node for node, (parent, _) in places.items() if parent < 0), None)
        kept = [root, *(node for node, s in states.items() if node != root and s.visits >= least)]
        index = {node: k for k, node in enumerate(kept)}
        for node in kept[1:]:
            parent, c = places[node]
            states[parent].to[c] = index[node]
        self = cls.__new__(cls)
        self.states = [states[node] for node in kept]
        self._merge()
        return self

    def counts(self, strings: Iterable[str]) -> list[tuple[int, str, int]]:
        """(state, character, how often it stands there) of the strings; the empty character is the end."""
        found: list[dict[str, int]] = [{} for _ in self.states]
        to = [s.to for s in self.states]
        for text in strings:
            at = 0
            for c, char in zip(symbols(text), text):
                held = found[at]
                held[char] = held.get(char, 0) + 1
                at = to[at].get(c, 0)
            found[at][""] = found[at].get("", 0) + 1
        return [(k, char, n) for k, held in enumerate(found) for char, n in held.items()]

    def recounted(self, counts: Iterable[tuple[int, str, int]]) -> Automaton:
        """With the states' counts put to these, which are those of all its strings."""
        for s in self.states:
            s.visits, s.ends, s.times, s.chars = 0, 0, {}, {}
        for k, char, n in sorted(counts):
            s = self.states[k]
            s.visits += n
            if char:
                s.seen(symbols(char), char, n)
                s.to.setdefault(symbols(char), 0)
            else:
                s.ends += n
        self._logs()
        return self

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = (self.states[k] for k in todo.pop())
            if _differ(x.ends, x.visits, y.ends, y.visits):
                return False
            for c in x.times.keys() | y.times.keys():
                if _differ(x.times.get(c, 0), x.visits, y.times.get(c, 0), y.visits):
                    return False
                if c in x.chars and c in y.chars:
                    # the commonest character of either shows a literal
                    for char in {max(z.chars[c], key=z.chars[c].get) for z in (x, y)}:
                        if _differ(x.chars[c].get(char, 0), x.times[c], y.chars[c].get(char, 0), y.times[c]):
                            return False
                if c in x.to and c in y.to:
                    todo.append((x.to[c], y.to[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            i, j = todo.pop()
            x, y = self.states[i], self.states[j]
            x.visits += y.visits
            x.ends += y.ends
            for c, held in y.chars.items():
                for char, n in held.items():
                    x.seen(c, char, n)
                if c not in y.to:
                    continue
                if c in x.to:
                    todo.append((x.to[c], y.to[c]))
                else:
                    x.to[c] = y.to[c]

    def _merge(self) -> None:
        accepted, waiting = [0], deque((0, c) for c in sorted(self.states[0].to))
        done = {0}
        while waiting:
            parent, c = waiting.popleft()
            child = self.states[parent].to[c]
            if child in done:
                continue
            for old in accepted:
                if self._compatible(old, child):
                    self.states[parent].to[c] = old
                    self._fold(old, child)
                    waiting.extend((s, x) for s in accepted for x in sorted(self.states[s].to) if self.states[s].to[x] not in done)
                    break
            else:
                accepted.append(child)
                done.add(child)
                waiting.extend((child, x) for x in sorted(self.states[child].to))
        self.size = len(accepted)
        # only accepted states are reached; a transition to a rarer node goes to the first
        index = {old: k for k, old in enumerate(accepted)}
        self.states = [self.states[old] for old in accepted]
        for s in self.states:
            s.to = {c: index[s.to[c]] if c in s.to else 0 for c in s.times}
        self._logs()

    def _logs(self) -> None:
        """The logarithms that scoring adds up: of each character in each state, and of ends."""
        self.log_chars: list[dict[str, float]] = []
        self.log_other: list[dict[str, float]] = []  # by class: of characters that were never seen there
        self.log_end = []
        for s in self.states:
            known, other = {}, {}
            for c, n in s.times.items():
                size = SIZES.get(c, 1)
                share = max(n / s.visits, UNSEEN)
                for char, m in s.chars[c].items():
                    known[char] = math.log(share * (m + BACK_OFF / size) / (n + BACK_OFF))
                other[c] = math.log(share * (BACK_OFF / size) / (n + BACK_OFF))
            self.log_chars.append(known)
            self.log_other.append(other)
            self.log_end.append(math.log(max(s.ends / s.visits if s.visits else 0, UNSEEN)))

    def score(self, text: str) -> float:
        """Log likelihood per symbol, the end included."""
        at, total, unseen = 0, 0.0, math.log(UNSEEN)
        states, chars, other = self.states, self.log_chars, self.log_other
        for c, char in zip(symbols(text), text):
            to = states[at].to.get(c)
            if to is None:
                # a class that the state has never seen: the even share of its characters, and from the start again
                total += unseen - math.log(SIZES.get(c, 1))
                at = 0
            else:
                known = chars[at].get(char)
                total += other[at][c] if known is None else known
                at = to
        return (total + self.log_end[at]) / (len(text) + 1)


def _tree(rows: Iterable[tuple[str, str, str]], least: dict[str, int]) -> Iterator[tuple]:
    """``NODES`` of strings (name, classes, text) that are sorted, and stand together with those of other tasks before the first
    and after the last: the nodes that ``least`` strings pass, and those on the paths of the first and last string."""
    path: list[list] = []  # from the root to the last string's end: node, parent, class, visits, ends, characters, on the first path
    name, before, first = None, "", True

    def closed(depth: int, last: bool = False) -> Iterator[tuple]:
        while len(path) > depth:
            node, parent, c, visits, ends, chars, edge = path.pop()
            if last or edge or visits >= least[name]:
                yield name, node, parent, c, ends, "".join(chars), list(chars.values())

    for own, classes, text in rows:
        shared = 0
        if own != name:
            yield from closed(0)
            name = own
            path.append([1, -1, "", 0, 0, {}, first])
        else:
            while shared < min(len(before), len(classes)) and before[shared] == classes[shared]:
                shared += 1
            yield from closed(shared + 1)
        for k, (c, char) in enumerate(zip(classes, text)):
            if k + 1 >= len(path):
                path.append([(path[k][0] * BASE + ord(c)) % PRIME, path[k][0], c, 0, 0, {}, first])
            path[k][3] += 1
            path[k][5][char] = path[k][5].get(char, 0) + 1
        path[len(classes)][3] += 1
        path[len(classes)][4] += 1
        before, first = classes, False
    yield from closed(0, last=True)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, schema)], schema=schema)


def learned(strings: DataFrame) -> dict[str, Automaton]:
    """The automaton of each set of ``strings``: (name, value), each value once, read a few times."""
    spark = strings.sparkSession
    least = {r[0]: max(2, r[1] // SHARE) for r in strings.groupBy("name").count().collect()}
    fields, arrow = arrow_schema(spark, NODES)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        out = []
        for row in _tree(rows, least):
            out.append(row)
            if len(out) >= 10_000:
                yield _columns(out, arrow)
                out = []
        yield _columns(out, arrow)

    classes = F.translate("value", "".join(map(chr, _CLASS)), "".join(_CLASS.values()))
    order = ["name", "classes", "value"]
    ordered = strings.select("name", classes.alias("classes"), "value").repartitionByRange(*order).sortWithinPartitions(*order)
    found: dict[str, list[tuple]] = {}
    for name, *node in ordered.mapInArrow(nodes, fields).collect():
        found.setdefault(name, []).append(tuple(node))
    automata = {name: Automaton.of_nodes(found[name], least[name]) for name in sorted(found)}
    fields, arrow = arrow_schema(spark, COUNTS)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(name, []).append(text)
            yield _columns([(name, *c) for name, own in texts.items() for c in automata[name].counts(own)], arrow)

    counted: dict[str, list[tuple]] = {}
    rows = strings.select("name", "value").mapInArrow(counts, fields).groupBy("name", "state", "char").agg(F.sum("n").alias("n"))
    for name, *count in rows.collect():
        counted.setdefault(name, []).append(tuple(count))
    return {name: automaton.recounted(counted[name]) for name, automaton in automata.items()}
