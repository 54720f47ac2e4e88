"""The command line, from JSON files to ranked pages and their quality."""

import json

import pytest

from tidewell.__main__ import main

PAGES = {7: "red fish swims far", 8: "blue fish sings", 9: "old stone walls stand for 42 years"}


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "pages").mkdir()
    for number, text in PAGES.items():
        (tmp_path / "pages" / f"{number}.json").write_text(json.dumps({"page_id": number, "title": "", "content": text}))
    rows = [{"query_id": "a", "query": "blue fish", "relevant_page_ids": [8]}, {"query_id": "b", "query": "stone walls", "relevant_page_ids": [9]}]
    (tmp_path / "queries.json").write_text(json.dumps(rows))
    return {name: str(tmp_path / name) for name in ("pages", "index", "queries.json")}


def test_build_search_evaluate(spark, folders, capsys):
    assert main(["build", folders["pages"], folders["index"]]) == 0
    said = capsys.readouterr().out
    counted = dict(part.split("=") for part in said.split())
    words = sum(len(text.split()) for text in PAGES.values())
    assert (counted["pages"], counted["chunks"], counted["tokens"]) == ("3", "3", str(words))
    assert {"chunking", "lexical", "writing", "pages_per_minute", "chunks_per_second"} <= set(counted)

    assert main(["search", folders["index"], "blue fish", "42"]) == 0
    blue, number = (line.split("\t") for line in capsys.readouterr().out.splitlines())
    assert blue[:2] == ["blue fish", "8"] and number[:2] == ["42", "9"]
    assert sorted(blue[1:]) == sorted(number[1:]) == ["7", "8", "9"]

    assert main(["evaluate", folders["index"], folders["queries.json"]]) == 0
    assert capsys.readouterr().out.startswith("2 queries, mean NDCG@10 1.000000, ")


def test_wrong_calls_explain_themselves(capsys):
    for args in ([], ["build", "x"], ["drop", "x", "y"]):
        assert main(args) == 2
        assert "build PAGES INDEX" in capsys.readouterr().out
