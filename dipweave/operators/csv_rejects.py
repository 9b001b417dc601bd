"""Loading delivered CSV lines, with the lines that fail set apart.

Each batch of lines is written to a scratch file in its task, which DuckDB reads with typed columns and reject tables; the line-level
errors are joined to the raw records by where their lines begin, and their type and column say why a record is set apart. A broken quote can make the reader swallow the records after it: records
that come back neither as a row nor as an error are read again without the culprits. Each line starts and ends with its record's number, at the end
behind a text that no line has, for the reader drops surplus columns without an error when it is made lenient enough to go on after a broken quote; a row with another end has too many.

In a few points the reader isn't the format, and there the letter of the format decides: lines with quotes or line breaks (it is laxer on quotes within a field), digits with `_` between them (it takes them for a number), columns it couldn't
read as a number that have only characters of numbers (it is stricter), and records it lost. A reject of one column says nothing of the columns before it nor of surplus ones, so these are looked at too.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The columns of a record in order, with the types they are loaded with.
COLUMNS = {
    "target_id": "string", "mission": "string", "t_min": "double", "depth_ppm": "double", "duration_days": "double", "a_dur_sigma": "double",
    "significance": "double", "delta_bic": "double", "tau_over_sigma": "double", "signs_agree": "boolean", "flagged": "boolean", "periodic": "boolean",
    "period_days": "double", "vetting_status": "string", "vetting_reasons": "string",
}
STATUSES = ("candidate", "eclipsing_binary", "flare", "artifact", "known_variable", "unresolved")
REASONS = ("broken quoting", "wrong column count", "invalid t_min", "invalid depth_ppm", "invalid vetting_status")
BLANKS = " \t"
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",\r\n]*)'
_LINE = re.compile(rf"{_FIELD}(?:,{_FIELD})*\Z")
_EACH = re.compile(rf"(?:^|,)({_FIELD})(?=,|\Z)")
#: Stand for the line breaks within a record while it is in the scratch file; one pair that no line of a batch has is taken.
_STAND_INS = [("\x1d", "\x1e"), ("\x1c", "\x1f"), ("", ""), ("\U000f0000", "\U000f0001")]
#: Repeated until no line has it, it stands before the record's number at the end of a line, so that no field can pass for that end.
END = "\ue000"
_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
_SQL = {"string": "{0}", "double": "try_cast(trim({0}, ' \t') AS DOUBLE)", "boolean": "try_cast(trim({0}, ' \t') AS BOOLEAN)"}


def _fields(line: str) -> list[str] | None:
    """The fields of a record, unquoted; None if the quoting is broken."""
    if '"' not in line and "\n" not in line and "\r" not in line:
        return line.split(",")
    return [m[1:-1].replace('""', '"') if m[:1] == '"' else m for m in _EACH.findall(line)] if _LINE.match(line) else None


def _positive(text: str) -> bool:
    text = text.strip(BLANKS)
    return bool(_NUMBER.match(text)) and 0 < float(text) < float("inf")


def exact_reason(line: str) -> str | None:
    """Why a record (without its last carriage return) is set apart by the letter of the format; None if it isn't."""
    fields = _fields(line)
    if fields is None:
        return REASONS[0]
    if len(fields) != len(COLUMNS):
        return REASONS[1]
    record = dict(zip(COLUMNS, fields))
    for k, reason in (("t_min", REASONS[2]), ("depth_ppm", REASONS[3])):
        if not _positive(record[k]):
            return reason
    return None if record["vetting_status"].strip(BLANKS).lower() in STATUSES else REASONS[4]


def _typed(fields: list[str]) -> list:
    """The values of one record, for those that the reader couldn't load."""
    out: list = []
    for kind, text in zip(COLUMNS.values(), fields):
        if kind == "string":
            out.append(text.strip(BLANKS) or None)
            continue
        try:
            low = text.strip(BLANKS).lower()
            out.append({"1": True, "0": False, "true": True, "false": False}.get(low) if kind == "boolean" else float(low.replace("_", "x")))
        except ValueError:
            out.append(None)
    return out


#: What the reader's types of errors mean; CAST goes by the column.
_ERRORS = {"MISSING COLUMNS": REASONS[1], "TOO MANY COLUMNS": REASONS[1], "UNQUOTED VALUE": REASONS[0], "t_min": REASONS[2], "depth_ppm": REASONS[3]}
_LIKE_A_NUMBER = re.compile(r"[0-9+\-.eE \t]*\Z")


class _Reader:
    """DuckDB over scratch files in the task's own folder, gone with the task."""

    def __init__(self) -> None:
        import duckdb

        self.folder = tempfile.TemporaryDirectory(prefix="csv-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.failures = duckdb.Error
        self.db.execute("SET preserve_insertion_order = false")

    def scan(self, numbers: pa.Array, lines: pa.Array) -> tuple[pa.Table, dict[int, str | None], set[int]]:
        """Rows (record_no and the columns); why records were rejected, None where that is for the letter of the format to say; records that swallowed others. Lines must not hold line breaks."""
        path, end = f"{self.folder.name}/lines.csv", END
        while pc.any(pc.match_substring(lines, end)).as_py():
            end += END
        number = numbers.cast(pa.string())
        raw = pc.binary_join_element_wise(number, lines, pc.binary_join_element_wise(pa.scalar(end), number, pa.scalar("\n"), ""), ",")
        length = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        with open(path, "wb") as f:
            for x in raw.to_pylist():
                f.write(x.encode("utf-8", "surrogatepass"))
        longest = int(length.max())
        size = f", max_line_size={longest}, buffer_size={longest * 2}" if longest > 2_000_000 else ""
        names = ", ".join(f"'{c}': '{'DOUBLE' if c in ('t_min', 'depth_ppm') else 'VARCHAR'}'" for c in COLUMNS)
        records = pa.table({"record": numbers, "start": pa.array(np.cumsum(length) - length + 1)})
        select = ", ".join(f"{_SQL[kind].format(c) if c not in ('t_min', 'depth_ppm') else c} AS {c}" for c, kind in COLUMNS.items())
        self.db.execute("DROP TABLE IF EXISTS reject_errors; DROP TABLE IF EXISTS reject_scans")
        self.db.register("records", records)
        try:
            rows = self.db.sql(f"""SELECT record_no, end_no, {select} FROM read_csv('{path}', header=false, auto_detect=false, delim=',', quote='"', escape='"', new_line='\\n', columns={{'record_no': 'BIGINT', {names}, 'end_no': 'VARCHAR'}}, store_rejects=true, rejects_limit=0, strict_mode=false, parallel=false{size})""").to_arrow_table()
            errors = self.db.execute("SELECT r.record, contains(rtrim(e.csv_line, chr(10)), chr(10)), e.error_type::VARCHAR, e.column_name FROM reject_errors e JOIN records r ON r.start = e.line_byte_position").fetchall()
        except self.failures:  # a state the reader can't leave: find the record by halves
            if len(numbers) == 1:
                return _EMPTY, {numbers[0].as_py(): None}, set()
            h = len(numbers) // 2
            a, b = self.scan(numbers[:h], lines[:h]), self.scan(numbers[h:], lines[h:])
            return pa.concat_tables([a[0], b[0]]), a[1] | b[1], a[2] | b[2]
        rows = pa.table({c: rows[c].combine_chunks() if rows.num_rows else pa.array([], rows[c].type) for c in rows.column_names})
        broken = pa.array(np.zeros(len(rows), bool))
        for c in rows.column_names:
            if pa.types.is_string(rows[c].type) or pa.types.is_large_string(rows[c].type):
                broken = pc.or_(broken, pc.fill_null(pc.match_substring(rows[c], "\n"), False))
        greedy = set(rows["record_no"].filter(broken).to_pylist()) | {n for n, more, _, _ in errors if more}
        whole = pc.fill_null(pc.equal(rows["end_no"].cast(pa.string()), pc.binary_join_element_wise(pa.scalar(end), rows["record_no"].cast(pa.string()), "")), False)
        why: dict[int, str | None] = dict.fromkeys(rows["record_no"].filter(pc.invert(whole)).to_pylist(), REASONS[1])
        for n, _, kind, column in errors:
            found = _ERRORS.get(column if kind == "CAST" else kind)
            before = why.get(n, found)
            why[n] = found if before is None or found is None else min(found, before, key=REASONS.index)
        good = pc.and_(whole, pc.invert(pc.is_in(rows["record_no"], pa.array(sorted(greedy), pa.int64()))))
        return rows.drop(["end_no"]).filter(good).cast(_EMPTY.schema), why, greedy

    def read(self, lines: pa.Array) -> tuple[pa.Table, dict[int, str | None]]:
        """Typed rows by place in lines, and the places rejected, with the reason or None."""
        odd = pc.equal(pc.bit_wise_and(pc.count_substring(lines, '"'), 1), 1)  # an open quote, which would swallow the lines after it
        why: dict[int, str | None] = dict.fromkeys(pc.indices_nonzero(odd).to_pylist())
        left, found = pc.indices_nonzero(pc.invert(odd)).cast(pa.int64()), []
        for _ in range(3):
            if not len(left):
                break
            good, wrong, greedy = self.scan(left, lines.take(left))
            found.append(good)
            here = set(left.to_pylist())
            why |= {n: r for n, r in wrong.items() if n in here} | {n: None for n in greedy & here}
            left = pa.array(sorted(here - set(good["record_no"].to_pylist()) - why.keys()), pa.int64())
        return pa.concat_tables(found) if found else _EMPTY, why | dict.fromkeys(left.to_pylist())


_EMPTY = pa.table({"record_no": pa.array([], pa.int64()), **{c: pa.array([], _ARROW[kind]) for c, kind in COLUMNS.items()}})


def _judged(line: str, reason: str | None) -> str | None:
    """Why a line of plain fields is set apart that the reader rejected for a reason; see the beginning of this file."""
    if reason is None:
        return exact_reason(line)
    if line.count(",") != len(COLUMNS) - 1:
        return REASONS[1]
    fields = dict(zip(COLUMNS, line.split(",")))
    column = reason.removeprefix("invalid ")
    if column in fields and (_LIKE_A_NUMBER.match(fields[column]) or column == "depth_ppm"):
        return exact_reason(line)
    return reason


def load_lines(lines: DataFrame, line: str = "raw_line", keys: tuple[str, ...] = ("line_id", "file_name", "line_no")) -> DataFrame:
    """One row for each record of `lines`: keys, the columns of COLUMNS, reason and rejected_line.

    A record that loads has typed values and a NULL reason; one set apart has a reason of REASONS (the first that holds, in that order),
    its raw line and NULL values. `line` holds one record, which may have line breaks in quoted fields; one carriage return at its end isn't part of it. A NULL or
    blank line is no record and gives no row. Columns that aren't judged become NULL where they can't be read as their type. A
    repeated row is a record of its own; further columns are left out; an empty table gives an empty result. Lines are read in the batches they come in, whatever file they are of: a record is a line by itself.
    """
    rows = lines.select(*keys, line).where(lines[line].isNotNull())
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = list(COLUMNS)
    schema = f"{kinds}, {', '.join(f'{c} {kind}' for c, kind in COLUMNS.items())}, reason string, rejected_line string"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            raw = batch.column(len(keys)).cast(pa.string())
            raw = pc.replace_substring_regex(raw, r"\r\z", "")
            record = pc.invert(pc.match_substring_regex(raw, r"\A[ \t\r\n]*\z"))
            batch, raw = batch.filter(record), raw.filter(record)
            if not len(raw):
                continue
            reader = reader or _Reader()
            cr, lf = next((p for p in _STAND_INS if not any(pc.any(pc.match_substring(raw, c)).as_py() for c in p)), _STAND_INS[-1])
            found, rejected = reader.read(pc.replace_substring(pc.replace_substring(raw, "\r", cr), "\n", lf))
            found = pa.table({c: found[c].combine_chunks() if found.num_rows else found[c] for c in found.column_names})
            # rows whose values are out of range, and lines the letter of the format has to judge
            blanks = lambda c: pc.utf8_trim(c, BLANKS)
            status = pc.fill_null(pc.is_in(pc.utf8_lower(blanks(found["vetting_status"])), pa.array(STATUSES)), False)
            ok = {c: pc.fill_null(pc.and_(pc.greater(found[c], 0), pc.is_finite(found[c])), False) for c in ("t_min", "depth_ppm")}
            at, reasons = found["record_no"].to_numpy(), np.full(len(raw), None, object)
            for reason, good in ((REASONS[4], status), (REASONS[3], ok["depth_ppm"]), (REASONS[2], ok["t_min"])):
                reasons[at[~good.to_numpy(zero_copy_only=False)]] = reason
            exact = set(pc.indices_nonzero(pc.match_substring_regex(raw, '["\r\n]|[0-9]_[0-9]')).to_pylist())
            check = {n: (raw[n].as_py(), rejected.get(n)) for n in exact | rejected.keys()}
            known, again = set(at.tolist()), []
            for n, (text, why) in check.items():
                reasons[n] = exact_reason(text) if n in exact else _judged(text, why)
                if reasons[n] is None and (n not in known or n in rejected):
                    again.append((n, _typed(_fields(text) or [])))
            place = np.full(len(raw), -1)
            place[at] = np.arange(len(at))
            place[[n for n, _ in again]] = len(at) + np.arange(len(again))
            place[reasons != None] = -1  # noqa: E711
            where = pa.array(place, pa.int64(), mask=place < 0)
            arrays = []
            for k, (c, kind) in enumerate(COLUMNS.items()):
                col = found[c].combine_chunks() if isinstance(found[c], pa.ChunkedArray) else found[c]
                if kind == "string":
                    col = blanks(pc.replace_substring(pc.replace_substring(col, cr, "\r"), lf, "\n"))
                    col = pc.if_else(pc.equal(col, ""), None, col)
                col = pa.concat_arrays([col, pa.array([v[k] for _, v in again], _ARROW[kind])]).take(where)
                arrays.append(pc.utf8_lower(col) if c == "vetting_status" else col)
            why = pa.array(reasons.tolist(), pa.string())
            out = [batch.column(k) for k in range(len(keys))] + arrays + [why, pc.if_else(pc.is_valid(why), raw, None)]
            yield pa.RecordBatch.from_arrays(out, names=[*keys, *names, "reason", "rejected_line"])

    return rows.mapInArrow(load, schema)
