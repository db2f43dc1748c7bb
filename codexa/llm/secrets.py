"""Secret scans with one combined automaton (operator 6).

Method. The regexes of RULES are parsed, and compiled by subset construction and minimised by partition refinement into transition arrays over bytes:

  * `find`: all rules at once, starting at every byte; its accepting state absorbs. Here the repeat at the end of a rule that has a least length is unrolled
    (in full if the rule has no fixed letters in front, else MARKED times), so that few documents are found in vain and none is missed.
  * `starts`: all rules reversed, at once, read backwards: after each byte, the set of rules of which a match begins there.
  * one array for each rule, anchored, read forwards: the longest match from a given start.

Texts are scanned by `find` in one pass over their UTF-8 bytes: a batch is cut into lanes at bytes from which every state of every array returns to the start (proven from
the arrays, so no match crosses them), and all lanes advance together in numpy; the last few long lanes are read byte by byte. Lanes that `find` accepts are read once backwards by
`starts`; from the leftmost start of a rule its own array gives the end, the next start is sought from there, and spans that are too short are dropped. That is
what leftmost, non-overlapping search gives, in time linear in the text. No regex library touches a text.

Kinds, as listed: assign, access, hex (the base), then github, slack, jwt, pem. Spans are code points, end exclusive.
Defined cases. Null text: as empty. Very long texts are scanned whole. Repeated rows alike. Empty table: no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .token_counts import groups

KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _ci(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind -> (pattern, group that must be long enough, its least length)
RULES = {
    "assign": (rf"({'|'.join(map(_ci, KEYWORDS))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "github": (r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
}
BASE = ("assign", "access", "hex")
#: Unrolled repeats behind fixed letters; lanes below which the scan goes byte by byte.
MARKED, FEW = 2, 24

# A parsed pattern: ("set", bytes), ("seq", parts), ("alt", parts), ("rep", part, least, most or None), ("group", number, part).


def parse(pattern: str) -> tuple:
    """The tree of a pattern of ASCII letters, escapes, sets, groups, alternatives and the repeats ? * +."""
    at = groups = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        if pattern[at] == "x":
            at += 3
            return int(pattern[at - 2 : at], 16)
        at += 1
        return ord(pattern[at - 1])

    def charset() -> frozenset[int]:
        nonlocal at
        found: set[int] = set()
        while pattern[at] != "]":
            lo = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                found.update(range(lo, char() + 1))
            else:
                found.add(lo)
        at += 1
        return frozenset(found)

    def alternatives() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence() -> tuple:
        nonlocal at, groups
        parts: list[tuple] = []
        while at < len(pattern) and pattern[at] not in "|)":
            if pattern[at] == "(":
                at, groups = at + 1, groups + 1
                number = groups
                parts.append(("group", number, alternatives()))
                at += 1
            elif pattern[at] == "[":
                at += 1
                parts.append(("set", charset()))
            else:
                parts.append(("set", frozenset([char()])))
            if at < len(pattern) and pattern[at] in "?*+":
                parts[-1] = ("rep", parts[-1], int(pattern[at] == "+"), 1 if pattern[at] == "?" else None)
                at += 1
        return ("seq", parts)

    return alternatives()


def length(node: tuple) -> tuple[int, int | None]:
    """The least and the most bytes that a tree matches."""
    kind, x = node[0], node[1]
    if kind == "set":
        return 1, 1
    if kind == "group":
        return length(node[2])
    if kind == "rep":
        lo, hi = length(x)
        return lo * node[2], None if node[3] is None or hi is None else hi * node[3]
    each = [length(p) for p in x]
    lows, highs = [lo for lo, _ in each], [hi for _, hi in each]
    if kind == "alt":
        return min(lows), None if None in highs else max(highs)
    return sum(lows), None if None in highs else sum(highs)


def backwards(node: tuple) -> tuple:
    kind, x = node[0], node[1]
    if kind == "set":
        return node
    if kind == "group":
        return ("group", x, backwards(node[2]))
    if kind == "rep":
        return ("rep", backwards(x), node[2], node[3])
    return (kind, [backwards(p) for p in (reversed(x) if kind == "seq" else x)])


def unrolled(node: tuple, group: int, least: int) -> tuple:
    """The tree of a rule with the endless repeat at its end, or at that of its group, written out as often as its least length asks for; every span long enough holds a match of it."""
    fixed = node[0] == "seq" and node[1][0][0] == "set" and len(node[1][0][1]) == 1
    inner = node[1][-1] if group else node
    body = inner[2] if group and inner[0] == "group" and inner[1] == group else inner if not group else None
    if body is None or body[0] != "seq" or body[1][-1][0] != "rep" or body[1][-1][3] is not None:
        return node
    lo, hi = length(("seq", body[1][:-1]))
    if lo != hi:
        return node
    last = body[1][-1]
    times = max(last[2], min(least - lo, MARKED) if fixed else least - lo)
    body = ("seq", [*body[1][:-1], *[last[1]] * times])
    return ("seq", [*node[1][:-1], ("group", group, body)]) if group else body


class States:
    """A nondeterministic automaton of several rules: empty moves, moves by sets of bytes, one end for each rule."""

    def __init__(self, trees: list[tuple]):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.starts, self.ends = [], {}
        for rule, tree in enumerate(trees):
            start = self._new()
            self.starts.append(start)
            self.ends[self._add(tree, start)] = rule

    def _new(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def _add(self, node: tuple, at: int) -> int:
        kind, x = node[0], node[1]
        if kind == "set":
            to = self._new()
            self.moves[at].append((x, to))
            return to
        if kind == "group":
            return self._add(node[2], at)
        if kind == "seq":
            for part in x:
                at = self._add(part, at)
            return at
        out = self._new()
        if kind == "alt":
            for part in x:
                begin = self._new()
                self.free[at].append(begin)
                self.free[self._add(part, begin)].append(out)
            return out
        begin = self._new()
        self.free[at].append(begin)
        end = self._add(x, begin)
        self.free[end].append(out)
        if node[3] is None:
            self.free[end].append(begin)
        if node[2] == 0:
            self.free[at].append(out)
        return out

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(x for x in seen if self.moves[x] or x in self.ends)


def compile_trees(trees: list[tuple], everywhere: bool, absorb: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(transitions: states x 256, rules that end in each state as bits) by subset construction and minimisation; state 0 is the start.

    everywhere: a match may start at every byte; else the array is anchored and its dead state is the one that leads to itself with all bytes. absorb: one accepting state, which is never left.
    """
    nfa = States(trees)
    sets = list({s for moves in nfa.moves for s, _ in moves})
    alike: dict[tuple, list[int]] = {}
    for b in range(256):  # bytes that stand in the same sets behave alike: one of each class is followed
        alike.setdefault(tuple(b in s for s in sets), []).append(b)
    lead = {g[0]: g for g in alike.values()}
    heads = {s: [b for b in lead if b in s] for s in sets}
    start = nfa.closure(set(nfa.starts))
    hit = frozenset([-1])
    number, todo, rows, accept = {start: 0}, [start], [], []
    while todo:
        now = todo.pop(0)
        row = np.zeros(256, np.int64)
        rows.append(row)
        accept.append(1 if now == hit else sum({1 << nfa.ends[x] for x in now if x in nfa.ends}))
        if now == hit:
            row[:] = number[now]
            continue
        by_byte: dict[int, set] = {b: set() for b in lead}
        for x in now:
            for s, to in nfa.moves[x]:
                for b in heads[s]:
                    by_byte[b].add(to)
        for b, targets in by_byte.items():
            to = nfa.closure(targets) | start if everywhere else nfa.closure(targets)
            if absorb and any(x in nfa.ends for x in to):
                to = hit
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[lead[b]] = number[to]
    full, accept = np.array(rows), np.array(accept, np.int64)
    brief = full[:, list(lead)]
    block = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:  # refine: states are equal while their blocks and the blocks they lead to are
        finer = np.unique(np.column_stack([block, block[brief]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.unique(block, return_index=True)[1]  # a state of each block
    place = np.argsort(np.argsort(order))  # blocks numbered by their first state, so the start is 0
    block = place[block]
    small, ends = np.zeros((block.max() + 1, 256), np.int64), np.zeros(block.max() + 1, np.int64)
    small[block], ends[block] = block[full], accept
    return small, ends


def compile_rules(rules: dict[str, tuple[str, int, int]] = RULES) -> tuple:
    """(find, starts, [own array of each rule with its parts for the group], the rules' least lengths) as plain arrays."""
    trees = [parse(p) for p, _, _ in rules.values()]
    find = compile_trees([unrolled(t, g, n) for t, (_, g, n) in zip(trees, rules.values(), strict=True)], True, absorb=True)
    starts = compile_trees([backwards(t) for t in trees], True)
    own = []
    for tree, (_, group, least) in zip(trees, rules.values(), strict=True):
        # a group that is asked for stands at the end: what is in front of it has an array of its own
        front = compile_trees([("seq", tree[1][:-1])], False) if group else None
        own.append((compile_trees([tree], False), front, least))
    return find, starts, own


class Scanner:
    def __init__(self, compiled: tuple, lane: int = 512):
        (table, accept), (self.back, self.begins), own = compiled
        self.start, self.accept, self.lane = 0, int(np.flatnonzero(accept)[0]), lane
        self.flat = (table * 256).astype(np.int32).reshape(-1)
        self.steps = self.flat.tolist()
        calm = (np.delete(table, self.accept, axis=0) == 0).all(axis=0) & (self.back == 0).all(axis=0)
        self.own = []
        for (t, ends), front, least in own:
            dead = int(np.flatnonzero((t == np.arange(len(t))[:, None]).all(axis=1))[0])
            calm &= (t == dead).all(axis=0)
            self.own.append((t.tolist(), (ends > 0).tolist(), dead, (front[0].tolist(), (front[1] > 0).tolist()) if front else None, least))
        self.back, self.begins, self.safe = self.back.tolist(), self.begins.tolist(), calm

    def lanes(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """For texts joined in data (uint8) with offsets ends: the (start, end) of every lane that holds a match of `find`."""
        if not len(data):
            return []
        calm = np.flatnonzero(self.safe[data])
        calm = calm[np.diff(calm // self.lane, prepend=-1) > 0] + 1
        cuts = np.unique(np.concatenate([ends, calm]))
        starts, sizes = cuts[:-1], np.diff(cuts)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state = np.zeros(len(starts), np.int32)
        falling, t = -sizes, 0
        while t < sizes[0] and (k := int(np.searchsorted(falling, -t, "left"))) >= FEW:  # lanes longer than t
            state[:k] = self.flat[state[:k] + data[starts[:k] + t]]
            t += 1
        hit, steps = self.accept * 256, self.steps
        for i in range(int(np.searchsorted(falling, -t, "left"))):
            at = int(state[i])
            for b in data[starts[i] + t : starts[i] + sizes[i]].tobytes():
                at = steps[at + b]
                if at == hit:
                    break
            state[i] = at
        found = np.flatnonzero(state == hit)
        return sorted(zip(starts[found].tolist(), (starts + sizes)[found].tolist(), strict=True))

    def spans(self, lane: bytes) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in bytes of every span of a lane."""
        begins, at, back, mark = [0] * len(lane), 0, self.back, self.begins
        for i in range(len(lane) - 1, -1, -1):
            at = back[at][lane[i]]
            begins[i] = mark[at]
        places: list[list[int]] = [[] for _ in self.own]
        for i, rules in enumerate(begins):
            while rules:
                low = rules & -rules
                places[low.bit_length() - 1].append(i)
                rules ^= low
        out = []
        for kind, ((table, ends, dead, front, least), at_places) in enumerate(zip(self.own, places, strict=True)):
            free = 0
            for p in at_places:
                if p < free:
                    continue
                state, end, i = 0, p, p
                while i < len(lane) and state != dead:
                    state = table[state][lane[i]]
                    i += 1
                    if ends[state]:
                        end = i
                free = end
                begin = p
                if front:  # the group begins where the front part has matched the most
                    state, i = 0, p
                    while i < end:
                        state = front[0][state][lane[i]]
                        i += 1
                        if front[1][state]:
                            begin = i
                if end - begin >= least and end > p:
                    out.append((p, kind, end))
        return sorted(out)


def secret_scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, a count for each base kind, base_sha256, spans and n_spans."""
    kinds = list(RULES)
    compiled = docs.sparkSession.sparkContext.broadcast(compile_rules())  # as large as the rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(compiled.value)
        for batch in batches:
            for a, b in groups(batch.column(1)):
                part = batch.slice(a, b - a)
                column = pa.concat_arrays([part.column(1).cast(pa.large_string()).fill_null("")])
                ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
                ends = ends - ends[0]
                spans: list[list] = [[] for _ in range(len(column))]
                for lo, hi in scanner.lanes(data, ends):
                    row = int(np.searchsorted(ends, lo, "right")) - 1
                    spans[row] += [(p + lo - int(ends[row]), k, q + lo - int(ends[row])) for p, k, q in scanner.spans(data[lo:hi].tobytes())]
                for row in (i for i, s in enumerate(spans) if s):  # bytes to code points
                    points = np.concatenate([[0], np.cumsum((data[ends[row] : ends[row + 1]] & 0xC0) != 0x80)])
                    spans[row] = [(int(points[p]), k, int(points[q])) for p, k, q in spans[row]]
                text = [[f"{kinds[n]}:{p}:{q}" for p, n, q in s] for s in spans]
                base = [",".join(x for x in t if x.split(":")[0] in BASE) for t in text]
                counts = [pa.array([sum(1 for _, n, _ in s if n == k) for s in spans], pa.int64()) for k in range(len(BASE))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([",".join(t) for t in text], pa.string()), pa.array([len(s) for s in spans], pa.int64())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
