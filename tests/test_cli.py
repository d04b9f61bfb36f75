import json

from termloom.cli import main


def test_store_lookup_annotate_and_evaluate(spark, tmp_path, capsys):
    at, d = str(tmp_path / "store"), tmp_path / "in"
    d.mkdir()
    (d / "order-2031.txt").write_text("\n".join(f"{i:05d} {c:<7} {f} {n:<60} {n}" for i, (c, f, n) in enumerate([("Q10", 0, "Toes"), ("Q101", 1, "Bent toe"), ("Q102", 1, "Lost toe")], 1)))
    (d / "list.csv").write_text('code,description,maps_to\nT1,"Toe, crooked",Q10.1\n')
    (d / "terms.csv").write_text("# terms\nterm,expected\nbent toe,Q10\nmissing,*\n")
    assert main(["--store", at, "init"]) == 0
    assert main(["--store", at, "load", "icd10cm", str(d)]) == 0 and "'codes': 3" in capsys.readouterr().out
    assert main(["--store", at, "load", "codes", str(d / "list.csv"), "--vocabulary", "LIST", "--maps-to", "ICD10CM"]) == 0 and "'maps_to': 1" in capsys.readouterr().out
    main(["--store", at, "codes", "toe crooked", "--json"])
    assert [json.loads(x)["code"] for x in capsys.readouterr().out.split("\n") if x.startswith("{")] == ["Q10.1"]
    main(["--store", at, "annotate", "No bent toe, but a lost toe.", "--json"])
    got = [json.loads(x) for x in capsys.readouterr().out.split("\n") if x.startswith("{")]
    assert [(g["text"], g.get("assertion"), g["key"], g["codes"][0]["code"]) for g in got] == [("bent toe", "negated", "icd10cm:Q10.1", "Q10.1"), ("lost toe", None, "icd10cm:Q10.2", "Q10.2")]
    main(["--store", at, "evaluate", str(d / "terms.csv")])
    assert "2|1|1" in capsys.readouterr().out.replace(" ", "")


def test_extract(spark, tmp_path):
    words = [("d", 1, 10.0, 10.0, 20.0, "A-1"), ("d", 1, 10.0, 40.0, 60.0, "Moss"), ("d", 1, 20.0, 40.0, 60.0, "green"), ("d", 2, 5.0, 10.0, 20.0, "A-2")]
    spark.createDataFrame(words, "doc_id string, page int, top double, x0 double, x1 double, text string").write.parquet(str(tmp_path / "w"))
    (tmp_path / "p.toml").write_text('payer = "N"\nkind = "codes"\nrecord = "(A-[0-9])(?= |$)"\nrecord_max_x = 20\n')
    main(["extract", str(tmp_path / "w"), "--profile", str(tmp_path / "p.toml"), "--out", str(tmp_path / "o"), "--pages", "1", "--report", str(tmp_path / "r.md")])
    got = spark.read.option("header", "true").csv(str(tmp_path / "o")).collect()
    assert [(r["code"], r["description"]) for r in got] == [("A-1", "Moss green")] and "Rows: 1" in (tmp_path / "r.md").read_text()
