"""What checks report: one vocabulary for all levels, as records, JSON, text and rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .model import Spot

#: Codes by kind.
CODES = {
    "type_mismatch": "M01", "missing_in_data": "M02", "extra_in_data": "M03", "missing_source": "M04", "unreadable_source": "M05", "missing_table": "M06", "extra_table": "M07", "invalid_typedef": "M08",
    "invalid_column_type": "M09", "unloadable_extension": "M10", "nulls_in_required": "D01", "duplicate_key": "D02", "duplicate_values": "D03", "orphaned_values": "D04", "cardinality_violation": "D05",
}
#: A report names so many offending rows at most.
SAMPLE_ROWS = 5


@dataclass
class Problem:
    kind: str
    message: str
    severity: str = "error"
    code: str | None = None
    expected: str | None = None
    column: str | None = None
    table: str | None = None
    hint: str | None = None
    suggestion: dict | None = None
    spots: list[Spot | None] = field(default_factory=list)
    payload: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.code = self.code or CODES.get(self.kind)

    @property
    def spot(self) -> Spot | None:
        return self.spots[-1] if self.spots else None

    @property
    def level(self) -> str | None:
        return {"S": "spec", "M": "meta", "D": "data"}.get((self.code or " ")[0])

    def as_dict(self) -> dict:
        said = {k: getattr(self, k) for k in ("code", "severity", "message", "column", "expected", "hint", "suggestion")}
        out = {k: v for k, v in said.items() if v is not None} | {"kind": self.kind} | self.payload
        if self.spot:
            s = self.spot
            out["location"] = {"start_line": s.line, "start_column": s.column, "end_line": s.end_line, "end_column": s.end_column}
        return out


class Report:
    """Problems in the order of their discovery, but those of the spec level by place."""

    def __init__(self, path: str = "", text: str = ""):
        self.path, self.text, self.items = path, text, []

    def add(self, kind: str, message: str, *spots: Spot | None, **more) -> Problem:
        self.items.append(Problem(kind, message, spots=[s for s in spots if s], **more))
        return self.items[-1]

    def spec(self, code: str, expected: str, message: str, *spots: Spot | None, severity: str = "error") -> Problem:
        return self.add("spec", message, *spots, code=code, expected=expected, severity=severity)

    def sort(self) -> None:
        self.items.sort(key=lambda p: (p.spot is None, p.spot and (p.spot.line, p.spot.column)))

    @property
    def status(self) -> str:
        kinds = {p.severity for p in self.items}
        return next((s for s in ("error", "warning") if s in kinds), "ok")

    @property
    def exit_code(self) -> int:
        return int(self.status == "error")

    def codes(self) -> list[str | None]:
        return [p.code for p in self.items]

    def to_json(self) -> str:
        return json.dumps({"status": self.status, "problems": [p.as_dict() for p in self.items]}, indent=2)

    def to_text(self) -> str:
        """Each problem with its source lines; the last is the offending one."""
        lines, out = self.text.split("\n"), []
        for p in self.items:
            out.append(f"{p.severity}{f'[{p.code}]' if p.code else ''}: {p.expected or p.message}")
            shown = {s.line: s for s in p.spots if s.line < len(lines)}
            width = len(str(max(shown, default=0) + 1))
            for n, s in sorted(shown.items()):
                out.append(f"  {n + 1:>{width}} | {lines[n]}")
                if s == p.spot:
                    out.append(f"  {'':>{width}} | {' ' * s.column}{'^' * max(1, (s.end_column if s.end_line == n else len(lines[n])) - s.column)} {p.message}")
            if not shown and p.expected:
                out.append(f"  {p.message}")
            if p.payload.get("rows"):
                out.append(f"  {row_sample(p.payload['rows'], p.payload['count'])}")
            if p.hint:
                out.append(f"  hint: {p.hint}")
        return "\n".join(out)

    def to_plain(self) -> str:
        where = lambda p: f"{self.path}:{p.spot.line + 1}:{p.spot.column + 1}: " if p.spot else ""
        return "\n".join(f"{where(p)}{p.severity}{f'[{p.code}]' if p.code else ''}: {p.message}" for p in self.items)

    def to_df(self, spark):
        """(code, kind, severity, level, table_name, column_name, count, message) of each problem, for tables of reports."""
        rows = [(p.code, p.kind, p.severity, p.level, p.table, p.column, p.payload.get("count"), p.message) for p in self.items]
        return spark.createDataFrame(rows, "code string, kind string, severity string, level string, table_name string, column_name string, count bigint, message string")


def row_sample(rows: list[int], count: int) -> str:
    return ("row: " if count == 1 else "rows: ") + ", ".join(map(str, rows)) + (", …" if count > len(rows) else "")
