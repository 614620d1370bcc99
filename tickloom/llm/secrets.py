"""Secret scans: the expressions of all rules compiled into one minimal deterministic automaton, run over each text's bytes once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.llm.automata import Positions, automaton
from tickloom.llm.common import packed, unpacked

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


@dataclass(frozen=True)
class Rule:
    """kind: name; pattern: what is consumed, leftmost and longest, without overlaps; needs: what such a match must also be from its
    first to its last byte to count (None: nothing more); fold: letters count in either case; base: whether its spans are base spans."""

    kind: str
    pattern: str
    needs: str | None = None
    fold: bool = False
    base: bool = True


# The key words, prefixes and least lengths by which secrets are told.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]"""
RULES = (
    Rule("assign", ASSIGN + "+", needs=ASSIGN + "{12,}", fold=True),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]{10,}", base=False),
)


class Scanner:
    """The compiled rules. One automaton reads texts from right to left and tells at each byte which rules have a match that begins there.
    Each match is then followed from its beginning by the small automaton of its own rule, which ends where the rule can't go on."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, every, self.ahead, self.wanted = rules, Positions(), [], []
        for k, rule in enumerate(rules):
            patterns = [rule.pattern] + ([rule.needs] if rule.needs else [])
            own = Positions()
            for pattern in patterns:
                every.add(pattern, rule.fold)
                own.add(pattern, rule.fold)
            ahead = automaton(own, anywhere=False)
            self.ahead.append((ahead, (1 << len(patterns)) - 1))
            self.wanted += [(k, 0, rule.base), *([(k, 1, False)] if rule.needs else [])]
        self.whole = automaton(every.turned(), anywhere=True)
        self.linked: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"linked": None}  # rows of rows are built anew where they are used

    def begins(self, data: bytes) -> list[tuple[int, int]]:
        """(place, rules that match from there), from right to left: the one pass over all bytes."""
        if self.linked is None:
            self.linked = self.whole.linked(), [(a.kinds, *a.linked(), full) for a, full in self.ahead]
        (row, rules), end, found = self.linked[0], len(data) - 1, []
        for at, kind in enumerate(data.translate(self.whole.kinds)[::-1]):
            row = row[kind]
            if row[rules]:
                found.append((end - at, row[rules]))
        return found

    def longest(self, data: bytes, start: int, rule: int, pattern: int) -> tuple[int, bool]:
        """End of the longest match of a rule's pattern from start, and whether all that the rule needs ends there too."""
        kinds, row, rules, full = self.linked[1][rule]
        end, whole = start, False
        for at in range(start, len(data)):
            row = row[kinds[data[at]]]
            accepted = row[rules]
            if accepted >> pattern & 1:
                end, whole = at + 1, accepted == full
            elif row[0] is row and all(x is row for x in row[:rules]):
                break
        return end, whole

    def spans(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(start, rule, end, base) in code points, by start, then rule."""
        data = text.encode()
        begins = self.begins(data)
        if not begins:
            return []
        found: dict[tuple[int, int, int], bool] = {}
        for bit, (rule, pattern, base) in enumerate(self.wanted):
            bound = 0
            for start, mask in reversed(begins):
                if start >= bound and mask >> bit & 1:
                    bound, whole = self.longest(data, start, rule, pattern)
                    if whole:
                        found[start, rule, bound] = found.get((start, rule, bound), False) or base
        leads = np.cumsum(np.concatenate([[0], (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80]))
        return [(int(leads[start]), rule, int(leads[end]), base) for (start, rule, end), base in sorted(found.items())]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of docs, with spans: kind, start and end in code points (end exclusive) and base, by start, then rule, then end.

    docs: text and any more columns; a column `spans` is replaced, all others are passed on unread. Whole texts are read. A rule's base
    spans are its leftmost, longest matches without overlap, of which those that lack what the rule needs are dropped after they
    were consumed. The automaton also finds what such a dropped match hides: matches of the full rule beside or inside it, and the matches of
    rules that aren't base; these spans have base false. Letters of a rule that folds are ASCII letters.
    Null, empty and blank texts have no spans; repeated rows are treated one by one; an empty table gives no rows.

    The automata are made once, on the driver, and depend on the rules alone. Rows need nothing of one another, so nothing is
    shuffled; a text costs time in proportion to its bytes, and a task holds one batch of texts at a time.
    """
    scanner = Scanner(tuple(rules))
    texts = packed(docs.withColumn("text", F.col("text").cast("string")), ["text"])
    names = texts.columns
    schema = StructType([*texts.schema.fields, *StructType.fromDDL(f"spans {SPANS}")])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[{"kind": scanner.rules[r].kind, "start": s, "end": e, "base": b} for s, r, e, b in scanner.spans(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(lists, kind)], names=[*names, "spans"])

    return unpacked(texts.mapInArrow(run, schema), docs.columns, {"spans": F.col("spans")})
