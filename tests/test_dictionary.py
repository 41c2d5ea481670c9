"""Reading dictionaries and the rules that they keep by themselves."""

import pytest
from lexispark.plans.joins import Conjunct, Join, JoinColumn, JoinProblem
from lexispark.plans.loader import find_dictionary
from lexispark.plans.problems import Report, row_sample
from lexispark.plans.spec_rules import check_document, is_version_number, time_zone_ok

HEAD = '$version: "0.2.0"\n$learn_more: https://example.org\n'
OLD = '$version: "0.1.0"\n$learn_more: https://example.org\n'


@pytest.fixture
def check(tmp_path):
    def run(text, head=HEAD):
        path = tmp_path / "my-dict.yaml"
        path.write_text(head + text)
        return check_document(path)

    return run


def codes(found):
    return [p.code for p in found[0].items]


def table(*columns, name="t", more=""):
    return f"  - name: {name}\n{more}    columns:\n" + "".join(f"      - {c}\n" for c in columns)


def two(relation, left="{name: id, constraints: [primary_key]}", right="{name: ref, constraints: [foreign_key]}"):
    return "tables:\n" + table(left, name="a") + table(right, name="b") + "relationships:\n  - " + relation + "\n"


def test_clean(check):
    report, d = check(two("{cardinality: many-to-one, join: b.ref = a.id}"))
    assert report.items == [] and d.rich and [t.name.value for t in d.tables] == ["a", "b"]
    assert [(t.table, t.column) for t in d.foreign_key_targets("b", "ref")] == [("a", "id")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (two("{cardinality: many-to-one, join: b.other = a.id}"), ["S01", "S03"]),
        (two("{cardinality: many-to-one, join: b.ref >= a.id}"), ["S01"]),
        (two("{cardinality: many-to-one, join: c.x = a.id}"), ["S01", "S02"]),
        (two("{cardinality: many-to-one, join: b.ref == a.id AND}"), ["S01", "S04"]),
        (two("{cardinality: many-to-one, join: b.ref = A.id}"), ["S01", "S02"]),
        (two("{cardinality: one-to-many, join: b.ref = a.id}"), ["S06"]),
        (two("{cardinality: one-to-one, join: b.ref = a.id}"), ["S06"]),
        (two("{cardinality: one-to-many, join: a.id = b.ref}"), []),
        (two("{cardinality: many-to-one, join: b.ref = a.id, conflicts: [ref]}"), ["S05"]),
        ("tables:\n" + table("{name: x}") + table("{name: y}", name="u") + table("{name: z}", name="v") + "relationships: [{cardinality: many-to-one, join: t.x >= u.y AND t.x <= v.z}]\n", ["S04"]),
        ("tables:\n" + table("{name: x}", "{name: X}"), ["S10"]),
        ("tables:\n" + table("{name: x}") + table("{name: x}", name="T"), ["S10"]),
        ("tables:\n" + table('{name: ""}', name='""'), ["S11", "S11"]),
        ("tables:\n" + table("{name: x, time_zone: Mars/Base}"), ["S15"]),
        ("tables:\n" + table("{name: x}", more="    description: d\n    details: e\n"), ["S16", "S16"]),
        ("version: {}\n", ["S17"]),
        ("version: {number: 1.2.3, hash: x}\n", ["S17"]),
        ("version: {number: 1.2}\n", ["S17"]),
        ("version: {number: 1.2.3-rc.1+b5}\n", []),
        ("version: {date: 2024-02-30}\n", ["S17"]),
        ("version: {date: 2024-02-29}\n", []),
        ("typedef: {1: INTEGER}\n", ["S18"]),
        ('duckdb: {extensions: [json, json, "", "a-b"]}\n', ["S20", "S19", "S19"]),
    ],
)
def test_rules(check, text, want):
    assert sorted(codes(check(text))) == sorted(want)


def test_learn_more(check):
    report, d = check("tables: []\n", head='$version: "0.2.0"\n')
    assert codes((report, d)) == ["S09"] and report.status == "warning" and report.exit_code == 0 and d is not None
    assert report.items[0].suggestion["replacement"].startswith("$learn_more:")


def old(column):
    return "tables:\n" + table(column, "{name: other}", name="t")


@pytest.mark.parametrize(
    ("column", "want"),
    [
        ("{name: x, type: enum}", ["S07"]),
        ("{name: x, type: enum, values: [a], range: [1, 2], examples: [a]}", ["S07", "S07"]),
        ("{name: x, type: boolean, values: [true]}", ["S07"]),
        ("{name: x, type: string, examples: [a, 1, null]}", []),
        ("{name: x, type: string, examples: [[a]]}", ["S12"]),
        ("{name: x, type: number(id), range: [1, 2]}", ["S07", "S07"]),
        ("{name: x, type: number(quantity), range: [1, 2], units: kg}", []),
        ("{name: x, type: number(ordinal), range: [1, 2], units: kg}", ["S08"]),
        ("{name: x, units: kg}", ["S08"]),
        ("{name: x, type: number(quantity), range: [2, 1]}", ["S13"]),
        ("{name: x, type: number(quantity), range: ['a', 1]}", ["S12"]),
        ("{name: x, type: date, range: [2024-01-02, 2024-01-01]}", ["S13"]),
        ("{name: x, type: date, range: [-.inf, 2024-01-01]}", []),
        ("{name: x, type: date, range: [.inf, 2024-01-01]}", ["S13"]),
        ("{name: x, type: date, range: [yesterday, 2024-01-01]}", ["S12"]),
        ("{name: x, type: datetime, range: ['2024-01-01T10:00:00+02:00', '2024-01-01T09:00:00Z']}", []),
        ("{name: x, type: datetime, range: ['2024-01-01T10:00:00', '2024-01-01T11:00:00Z']}", ["S12"]),
        ("{name: x, type: datetime, time_zone: UTC, range: ['2024-01-01T10:00:00', '2024-01-01T11:00:00']}", []),
        ("{name: x, type: string, examples: [a], time_zone: UTC}", ["S14"]),
        ("{name: Other, type: number, examples: [1]}", []),
    ],
)
def test_older_rules(check, column, want):
    assert sorted(codes(check(old(column), head=OLD))) == sorted(want)


@pytest.mark.parametrize(
    ("text", "head", "kind"),
    [
        ("tables: [", HEAD, "parse"),
        ("tables: []\ntables: []\n", HEAD, "parse"),
        ("colour: red\n", HEAD, "schema"),
        ("tables: [{name: t}]\n", HEAD, "schema"),
        ("tables: [{name: t, columns: [{name: x, constraints: [maybe]}]}]\n", HEAD, "schema"),
        ("tables: [{name: t, columns: [{name: x, range: [1]}]}]\n", HEAD, "schema"),
        ("relationships: [{cardinality: some, join: a.b = c.d}]\n", HEAD, "schema"),
        ("tables: []\n", "$version: 0.3.0\n", "schema"),
        ("tables: []\n", "$version: 2\n", "schema"),
        ("tables: []\n", "", "schema"),
        ("", "", "schema"),
        ("tables: [{name: t, columns: [{name: x, type: money}]}]\n", OLD, "schema"),
        ("typedef: {a: INTEGER}\n", OLD, "schema"),
    ],
)
def test_what_stops_loading(check, text, head, kind):
    report, d = check(text, head)
    assert d is None and [p.kind for p in report.items] == [kind] and report.exit_code == 1


def test_missing_file(tmp_path):
    report, d = check_document(tmp_path / "none.yaml")
    assert d is None and report.items[0].kind == "io"


def test_folder_of_a_dictionary(tmp_path):
    (tmp_path / "long-name-dict.yaml").write_text("")
    (tmp_path / "a-dict.yaml").write_text("")
    assert find_dictionary(tmp_path).name == "a-dict.yaml"
    assert find_dictionary(tmp_path / "x.yaml").name == "x.yaml"


def test_places(check):
    report, _ = check(two("{cardinality: many-to-one, join: b.ref = a.nothing}"))
    p = next(p for p in report.items if p.code == "S03")
    line = report.text.split("\n")[p.spot.line]
    assert line[p.spot.column : p.spot.end_column] == "a.nothing"
    assert "^^^^^^^^^ table `a` has no column `nothing`" in report.to_text()
    assert f":{p.spot.line + 1}:" in report.to_plain() and '"code": "S03"' in report.to_json()


def test_report_text():
    r = Report()
    assert r.status == "ok" and r.exit_code == 0
    assert row_sample([3, 7], 9) == "rows: 3, 7, …" and row_sample([3], 1) == "row: 3"


# --- joins ----------------------------------------------------------------


def shape(join):
    return [(c.left.table, c.left.column, c.op, c.right.table, c.right.column) for c in join]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a.x = b.y", [("a", "x", "=", "b", "y")]),
        ("a.x==b.y", [("a", "x", "=", "b", "y")]),
        ("a.x >= b.y and a.x<b.z", [("a", "x", ">=", "b", "y"), ("a", "x", "<", "b", "z")]),
        ("and.and = b.y AND a.x = b.y", [("and", "and", "=", "b", "y"), ("a", "x", "=", "b", "y")]),
    ],
)
def test_join_grammar(text, want):
    assert shape(Join.parse(text).conjuncts) == want


@pytest.mark.parametrize(("text", "at"), [("", 0), ("a.x", 3), ("a.x = ", 6), ("a.x = b", 6), ("a .x = b.y", 0), ("a.x = b.y or a.x = b.z", 10), ("a.x = b.y andante.x = b.z", 10), ("a.x != b.y", 4), ("a.x = b.y AND", 13), ("a.x = b.y;", 9), ("a.1 = b.y", 0)])
def test_joins_that_do_not_parse(text, at):
    with pytest.raises(JoinProblem) as e:
        Join.parse(text)
    assert e.value.at == at


def test_orientation():
    j = Join.parse("e.date >= p.start AND P.end >= E.date AND e.cal = p.cal")
    assert j.sides(True) == ("e", "p") and j.sides(False) == ("p", "e")
    assert shape(j.oriented(True)) == [("e", "date", ">=", "p", "start"), ("E", "date", "<=", "P", "end"), ("e", "cal", "=", "p", "cal")]
    assert [c.op for c in j.oriented(False)] == ["<=", ">=", "="]
    own = Join((Conjunct(JoinColumn("t", "boss"), "=", JoinColumn("t", "id")),))
    assert shape(own.oriented(True)) == [("t", "boss", "=", "t", "id")] and shape(own.oriented(False)) == [("t", "id", "=", "t", "boss")]
    assert j.tables() == ["e", "p", "P", "E"]


def test_small_rules():
    assert all(map(time_zone_ok, ("UTC", "naive", "Europe/Berlin", "Etc/GMT+3", "America/Argentina/Ushuaia")))
    assert not any(map(time_zone_ok, ("utc", "Berlin", "Europe/", "Europe/São", "+02:00")))
    assert all(map(is_version_number, ("1.2.3", "0.0.10-a.b", "1.2.3+x-y")))
    assert not any(map(is_version_number, ("1.2", "1.2.3.4", "v1.2.3", "1.2.3-", "1.2.3+a..b")))
