"""Secret scan: every rule in one pass of one minimised automaton.

The regular expressions of all rules are compiled into one deterministic automaton over byte
classes (``automaton.py``).  A batch of texts is one tape, cut into blocks of equal length that all
step together; each block is entered at the start state, and entered again from where the block
before it really ends until both runs agree, so one long token costs no more steps than many short
ones.  The states along the tape name the rules that end at each byte.  Where a run of such bytes
stops, a match ends; the same rule read backwards from there gives its leftmost start behind the
match before, which for these rules is what a search from left to right finds.

Lengths are not in the automaton: a rule names the least length of its last part, and a match whose
part is shorter is dropped after it has used up its bytes.

Results: a null text counts as empty; an empty text has no spans and the digest of the empty
string; rows that repeat are scanned on their own; columns other than ``doc_id`` and ``text`` are
not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .automaton import Automaton, compile_rules
from .common import pieces
from .words import byte_view


@dataclass(frozen=True)
class Rule:
    """``least`` is the least number of bytes from the first byte at which ``pattern`` has matched to the match's end.

    The pattern must end in a run of one byte set or in a fixed text, so that a match goes on until it cannot.
    """

    kind: str
    pattern: str
    least: int


#: Kinds, expressions, least lengths.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8),
    Rule("access", "AKIA[A-Z0-9]+", 12),
    Rule("hex", "[0-9a-f]+", 32),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
N_BASE = 3
#: Bytes of a block of the tape.
BLOCK = 256


@dataclass(frozen=True)
class Scanner:
    """All rules as one automaton, and each as one that reads from its start and one that reads from its end."""

    every: Automaton
    forwards: list[Automaton]
    backwards: list[Automaton]


@functools.cache
def scanner() -> Scanner:
    patterns = [r.pattern for r in RULES]
    return Scanner(compile_rules(patterns), [compile_rules([p], anywhere=False) for p in patterns], [compile_rules([p], anywhere=False, backwards=True) for p in patterns])


def states_along(machine: Automaton, data: np.ndarray) -> np.ndarray:
    """The state after each byte of ``data``, from the start state on."""
    n_blocks = max(1, -(-len(data) // BLOCK))
    tape = np.zeros(n_blocks * BLOCK, np.int32)
    tape[: len(data)] = machine.class_of[data]
    tape = np.ascontiguousarray(tape.reshape(n_blocks, BLOCK).T)
    states = np.empty((BLOCK, n_blocks), np.int16)
    state = np.zeros(n_blocks, np.int32)
    for i in range(BLOCK):
        state = machine.table[state * machine.n_classes + tape[i]]
        states[i] = state
    entered = np.zeros(n_blocks, np.int32)
    while True:
        before = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
        todo = np.flatnonzero(before != entered)
        if not len(todo):
            return np.ascontiguousarray(states.T).reshape(-1)[: len(data)]
        entered = before
        state = before[todo]
        for i in range(BLOCK):
            state = machine.table[state * machine.n_classes + tape[i, todo]]
            differs = states[i, todo] != state
            todo, state = todo[differs], state[differs]
            if not len(todo):
                break
            states[i, todo] = state


def start_of(machine: Automaton, raw: bytes, end: int, stop: int) -> int:
    """The leftmost start, ``stop`` or later, of a match that ends at ``end``; -1 if there is none."""
    state, found = 0, -1
    table, class_of, ends, n = machine.table, machine.class_of, machine.ends, machine.n_classes
    for at in range(end - 1, stop - 1, -1):
        state = table[state * n + class_of[raw[at]]]
        if state == machine.dead:
            break
        if ends[state]:
            found = at
    return found


def first_end(machine: Automaton, raw: bytes, start: int) -> int:
    """The place of the first byte at which what begins at ``start`` has matched."""
    state, at = 0, start
    while True:
        state = machine.table[state * machine.n_classes + machine.class_of[raw[at]]]
        if machine.ends[state]:
            return at
        at += 1


def matches(scan: Scanner, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, rule, end) of every match of sufficient length, in bytes; a text must end in a byte of no rule."""
    ending = scan.every.ends.astype(np.uint8)[states_along(scan.every, data)]
    raw = data.tobytes()
    out = []
    for rule, (own, forwards, backwards) in enumerate(zip(RULES, scan.forwards, scan.backwards, strict=True)):
        edge = np.diff(np.concatenate([[0], (ending >> rule) & 1, [0]]).astype(np.int8))
        begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        enough = stops - begins >= own.least
        if not enough.any():
            continue
        if forwards.ends[forwards.table[: forwards.n_classes]].any():  # all bytes of such a rule are of one kind, and its runs are its matches
            begins, stops = begins[enough], stops[enough]
            text = np.searchsorted(offsets, begins, "right") - 1
            out += zip(text.tolist(), begins.tolist(), [rule] * len(text), stops.tolist(), strict=True)
            continue
        text = np.searchsorted(offsets, begins, "right") - 1
        some = np.isin(text, text[enough])
        used = -1
        for of, stop in zip(text[some].tolist(), stops[some].tolist(), strict=True):
            start = start_of(backwards, raw, stop, max(used, int(offsets[of])))
            if start < 0:
                continue
            used = stop
            if stop - first_end(forwards, raw, start) >= own.least:
                out.append((of, start, rule, stop))
    return sorted(out)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_other long"


def scan_batch(scan: Scanner, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    ended = pa.compute.binary_join_element_wise(pa.compute.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    data, offsets = byte_view(ended)
    n = len(texts)
    counts = np.zeros((n, len(RULES)), np.int64)
    base: list[list[str]] = [[] for _ in range(n)]
    every: list[list[str]] = [[] for _ in range(n)]
    found = matches(scan, data, offsets)
    if found:
        point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        for text, start, rule, end in found:
            begin = int(point[start] - point[offsets[text]])
            shown = f"{RULES[rule].kind}:{begin}:{begin + end - start}"
            every[text].append(shown)
            if rule < N_BASE:
                base[text].append(shown)
            counts[text, rule] += 1
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in base]
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(counts[:, k]) for k in range(N_BASE)), pa.array(digests), pa.array([",".join(x) for x in every]), pa.array(counts[:, N_BASE:].sum(axis=1))],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: counts of each base kind, the digest of the base spans, all spans, further finds."""
    scan = scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield scan_batch(scan, batch.column("doc_id"), batch.column("text"))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _kind_sql(number: int, rule: Rule) -> str:
    """Rows (doc_id, start, kind, span) of one rule: matches, and the text between them, which gives their places."""
    pattern = rule.pattern.replace("(?i:", "(?:(?i)") if rule.kind == "assign" else rule.pattern
    pattern = pattern.replace("'", "''")
    head = pattern.rpartition("[")[0] if rule.kind != "pem" else ""
    if not head and pattern.endswith("+"):  # a bare run: no match of less can use up what a longer one needs
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    tail = f"length(regexp_replace(m, '^(?:{head})', ''))" if head else "length(m)"
    return f"""
select doc_id, place as start, {number} as kind, '{rule.kind}:' || place || ':' || (place + length(m)) as span from (
  select doc_id, unnest(found) as m, unnest(list_transform(found, lambda x, i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda y: length(y))), 0)))::bigint as place
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') as found, string_split_regex(coalesce(text, ''), '{pattern}') as gaps from documents where regexp_matches(text, '{pattern}')))
where {tail} >= {rule.least}"""


#: The same rows in DuckDB, whose own patterns find the matches.
ORACLE = (
    "with spans as ("
    + " union all ".join(_kind_sql(k, r) for k, r in enumerate(RULES))
    + f""")
select d.doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, kind) filter (where kind < {N_BASE}), '')) as base_sha256,
  coalesce(string_agg(span, ',' order by start, kind), '') as spans, count(*) filter (where kind >= {N_BASE}) as n_other
from documents d left join spans s on s.doc_id = d.doc_id group by d.doc_id
"""
)
