"""JSON arrays split over tasks: every cut gives the cases of the whole text."""

import json
import random

import pytest

from gradeloom.sources import json_arrays, tables

ODD = ['plain', 'a "quoted" text', 'back\\slash', 'ends in \\', '\\"', '[', ']', '{,}', '","', 'ünï€𝄞', '\\\\\\"', '', ' ', '\n', '"],["']


def case(rnd, k):
    return {"id": f"T-{k}", "category": rnd.choice(ODD), "question": "".join(rnd.choices(ODD, k=rnd.randrange(6))),
            "criteria": rnd.choices(ODD, k=rnd.randrange(3)), "weight": rnd.randrange(4), "nested": [[{"a": [1, {"b": ODD}]}], []]}


def items_of(data, step, tmp_path):
    """Items of one file cut into ranges of `step` bytes, by the task functions alone."""
    path = tmp_path / "x"
    path.write_bytes(data)
    out, quoted, depth, commas = [], 0, 0, 0
    with open(path, "rb") as f:
        for start in range(0, len(data), step):
            end = min(start + step, len(data))
            out += json_arrays._range_items(f, start, end, len(data), quoted, depth, commas)
            odd, delta_out, delta_in, commas_out, commas_in = json_arrays._summary(f, start, end)
            commas += dict(commas_in if quoted else commas_out).get(1 - depth, 0)
            depth += delta_in if quoted else delta_out
            quoted ^= odd
    return out, quoted, depth


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 10_000])
@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_items_do_not_depend_on_cuts(tmp_path, monkeypatch, step, piece):
    monkeypatch.setattr(json_arrays, "PIECE", piece)
    rnd = random.Random(step * 31 + piece)
    cases = [case(rnd, k) for k in range(4)] + [None, "text, [with] \\", 3.5, []]
    data = (" " + json.dumps(cases, ensure_ascii=False, indent=rnd.choice([None, 1])) + "\n").encode()
    rows, quoted, depth = items_of(data, step, tmp_path)
    assert [r for r in rows if r[2]] == [(None, None, "opened")] and (quoted, depth) == (0, 0)
    assert [(seq, json.loads(text)) for seq, text, note in rows if not note] == [(k, c) for k, c in enumerate(cases, 1)]


@pytest.mark.parametrize("step", [1, 4, 100])
@pytest.mark.parametrize("text, notes", [
    ("[]", ["opened"]), ("[ \n]", ["opened"]), ("", []), ("[1][2]", ["opened", "opened"]), ('{"a": [1]}', None), ("[1] x", None), ("x [1]", None), ("]", None), ('"[1]"', None),
])
def test_what_is_not_one_array(tmp_path, step, text, notes):
    rows, _, _ = items_of(text.encode(), step, tmp_path)
    found = [r[2] for r in rows if r[2]]
    assert found == notes if notes is not None else "stray" in found


def test_same_cases_as_the_whole_text(spark, tmp_path):
    rnd = random.Random(5)
    root = tmp_path / "arrays"
    (root / "in").mkdir(parents=True)
    files = {f"in/{n}.json": json.dumps([case(rnd, k) for k in range(n)]) for n in (0, 1, 30)}
    files |= {"mixed.json": json.dumps([1, case(rnd, 1), "x", None, case(rnd, 2)], indent=2), "empty.json": "", "object.json": '{"a": 1}', "open.json": '[{"id": "a"}', "quote.json": '[{"id": "a]',
              "bad.json": '[{"id": "a"}, {"id": }, {"id": "c"}]', "gap.json": '[{"id": "a"},, {"id": "b"}]', "last.json": '[{"id": "a"},]', "two.json": "[][]", "swapped.json": '[{"id": "a"]}'}
    for name, content in files.items():
        (root / name).write_text(content)

    def found(cases):
        return sorted((r.path.rsplit("/", 1)[1], r.test_seq, r.test_id or "", r.category or "", r.question or "", tuple(r.criteria), r.weight) for r in cases.collect())

    whole = tables.read_generated_json(spark, f"{root}/in") [0].unionByName(tables.read_generated_json(spark, f"{root}/*.json")[0])
    expected = found(whole)
    assert {r[0] for r in expected} == {"1.json", "30.json", "mixed.json"}
    for step in (50, 1 << 20):
        cases, rejected = json_arrays.read_arrays(spark, str(root), range_bytes=step, task_bytes=2_000)
        assert found(cases) == expected
        reasons = {r.path.rsplit("/", 1)[1]: (r.reason, r.bad_item) for r in rejected.collect()}
        assert set(reasons) == {n for n in files if "/" not in n} - {"mixed.json"}
        assert reasons["bad.json"] == ("bad item", 2) and reasons["gap.json"] == ("bad item", 2) and reasons["last.json"] == ("bad item", 2)
        assert {reasons[n][0] for n in ("empty.json", "object.json", "two.json")} == {"not one array"} and {reasons[n][0] for n in ("open.json", "quote.json")} == {"cut off"}


def test_one_file_on_many_tasks(spark, tmp_path):
    root = tmp_path / "arrays"
    root.mkdir()
    (root / "one.json").write_text(json.dumps([{"id": f"T-{k}", "question": "q" * 200} for k in range(2_000)]))
    cases, rejected = json_arrays.read_arrays(spark, str(root), range_bytes=10_000, task_bytes=40_000)
    assert rejected.count() == 0
    assert [r.test_id for r in cases.orderBy("test_seq").collect()] == [f"T-{k}" for k in range(2_000)]


def test_no_files(spark, tmp_path):
    cases, rejected = json_arrays.read_arrays(spark, str(tmp_path))
    assert cases.count() == 0 and rejected.count() == 0
