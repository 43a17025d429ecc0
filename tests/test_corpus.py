"""Texts of inspected assets by place and identity."""

import json

from tablewatch.operators import corpus

TEXT = lambda v, **more: {"value_kind": "text", "value": v} | more


def test_texts_of_all_branches_and_containers(spark):
    assets = [
        {"object_path": "/G/ST", "kind": "StringTable", "string_table_namespace": "NS", "string_table_entries": [{"key": "a", "source": "one"}, {"key": "", "source": "two"}]},
        {"object_path": "/G/DT", "kind": "DataTable", "rows": [{"name": "R1", "properties": [{"name": "M", "value_kind": "map", "entries": [{"key": TEXT("k", history="none"), "value": {"value_kind": "set", "values": [TEXT("v", history="base", namespace="N", key="K")]}}]}]}]},
        {"object_path": "/G/O", "kind": "UObject", "properties": [{"name": "S", "value_kind": "struct", "properties": [{"name": "T", **TEXT("deep", history="base", namespace="N", key="")}, {"name": "raw", "value_kind": "raw"}]}]},
        {"object_path": "/G/X", "kind": "Other", "properties": [{"name": "T", **TEXT("none")}]},
    ]
    docs = spark.createDataFrame([("f", json.dumps({"assets": assets})), ("g", None), ("h", "{"), ("i", "{}")], "package_file string, json string")
    found = sorted((r.id, r.text, r.status, r.namespace, r.key, r.reason, r.capability) for r in corpus.text_corpus(docs).collect())
    assert found == [
        ("occurrence:/G/DT:row:R1:property:M{0}.key:f", "k", "unresolved", None, None, "culture_invariant", "source_editable"),
        ("occurrence:/G/DT:row:R1:property:M{0}.value[0]:f", "v", "resolved", "N", "K", None, "source_editable"),
        ("occurrence:/G/O:property:S.T:f", "deep", "unresolved", None, None, "missing_key", "read_only"),
        ("occurrence:/G/ST:entry::f", "two", "unresolved", None, None, "missing_key", "source_editable"),
        ("occurrence:/G/ST:entry:a:f", "one", "resolved", "NS", "a", None, "source_editable"),
    ]
