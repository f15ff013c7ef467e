import hashlib
import json

from evidentia.sources import policies as P

GOV = {"reviewStatus": "provisional"}


def _one(spark, kind, *texts):
    rows = P.policies(spark.createDataFrame(list(enumerate(texts)), "file int, text string"), kind).collect()
    return [(r.issue, r.place) for r in sorted(rows, key=lambda r: r.file)]


def test_good_provisional_and_broken_files(spark, tmp_path):
    tab = {"tabPattern": "a*", "requiredFields": ["x"], "populationRequirement": None, "description": "ünï / \"q\""}
    (tmp_path / "tab-selection.json").write_text(json.dumps({"version": "1.2.3", "governance": GOV, "rules": [tab, tab]}))
    (tmp_path / "iob-classification.json").write_text("{")
    (tmp_path / "field-name-glossary").mkdir()
    (tmp_path / "field-name-glossary" / "a.json").write_text(json.dumps({"version": "1.0.0", "governance": {"reviewStatus": "approved"}, "entries": [1]}))
    got = {k: v.collect() for k, v in P.load_policy_tables(spark, str(tmp_path)).items()}
    assert {k: [(r.issue, r.place) for r in v] for k, v in got.items()} == {"tab-selection": [(None, None)], "iob-classification": [("PARSE", "root")], "field-name-glossary": [("VALIDATION", "governance")], "scenario-selection": [("NOT_FOUND", None)]}
    one = got["tab-selection"][0]
    assert one.policy_sha256 == hashlib.sha256(json.dumps([tab, tab], sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    rules = P.policy_rules(P.load_policy_tables(spark, str(tmp_path))["tab-selection"]).collect()
    assert sorted((r.position, r.tabPattern, r.requiredFields, r.populationRequirement) for r in rules) == [(0, "a*", ["x"], None), (1, "a*", ["x"], None)]
    assert one.source_sha256 == hashlib.sha256((tmp_path / "tab-selection.json").read_bytes()).hexdigest()


def test_every_fault_of_a_scenario(spark):
    cond = {"dimension": "d", "operator": "equals", "value": True, "source": "population"}
    rule = {"id": "1", "label": "l", "triggerConditions": [cond], "exclusionConditions": [], "defaultEffectiveDateRange": {"startDate": "2020-02-29", "endDate": None}}
    texts = []
    for change in ({}, {"triggerConditions": []}, {"label": " "}, {"more": 1}, {"exclusionConditions": [cond | {"operator": "is"}]}, {"exclusionConditions": [cond | {"value": None}]},
                   {"exclusionConditions": [cond | {"value": ""}]}, {"defaultEffectiveDateRange": {"startDate": "2021-02-29", "endDate": None}}, {"defaultEffectiveDateRange": {"startDate": "2021-02-01"}}, {"exclusionConditions": None}):
        texts.append(json.dumps({"version": "1.0.0", "governance": GOV, "scenarios": [rule, rule | change]}))
    bad = ("VALIDATION", "scenarios[1]")
    assert _one(spark, "scenario-selection", *texts) == [(None, None), bad, bad, bad, bad, bad, (None, None), bad, bad, bad]


def test_odd_texts_and_equal_policies(spark):
    root = ("VALIDATION", "root")
    assert _one(spark, "tab-selection", None, "", "[]", "null", "{}", '{"a":1,"a":2}') == [("PARSE", "root")] * 2 + [root] * 3 + [("PARSE", "root")]
    entry = {"workbookPattern": "p", "genericField": "g", "description": "d"}
    same = [json.dumps({"version": "1.0.0", "governance": GOV, "entries": [e]}, indent=i) for e, i in ((entry, None), (dict(reversed(entry.items())) | {"tabContext": None}, 2))]
    rows = P.policies(spark.createDataFrame([(i, x, "own") for i, x in enumerate([*same, same[0]])], "file int, text string, rules string"), "field-name-glossary").collect()
    assert len(rows) == 3 and len({r.policy_sha256 for r in rows}) == 1 and all(r.issue is None for r in rows)
    assert P.policies(spark.createDataFrame([], "file int, text string"), "iob-classification").count() == 0
