from segmill.sources import profiles


def test_profiles(spark, tmp_path):
    for name, files in {"dental": {profiles.PROMPT: "Be exact.", profiles.GLOSSARY: '{"en":"Jaw","vi":"hàm"}\n'}, "empty": {"x.txt": "x"}, ".hidden": {profiles.PROMPT: "no"}}.items():
        (tmp_path / name).mkdir()
        for f, text in files.items():
            (tmp_path / name / f).write_text(text)
    got = {r.name: (r.has_prompt, r.has_glossary) for r in profiles.available(spark, str(tmp_path)).collect()}
    assert got == {"dental": (True, True), "empty": (False, False)}
    assert profiles.resolve("a", ["r/a", "a"], "b", "r") == "a" and profiles.resolve("a", ["r/a"], "b", "r") == "r/a" and profiles.resolve("", ["b/"], "b", "r") is None
    assert [r.vi for r in profiles.glossary(spark, f"{tmp_path}/dental").collect()] == ["hàm"]
    assert profiles.prompt(spark, f"{tmp_path}/dental", "vi") == "Be exact." and "vi" in profiles.prompt(spark, None, "vi")
    found = profiles.available(spark, str(tmp_path))
    base = str(tmp_path)
    assert profiles.assets(found, "dental", glossary_="g.jsonl", base=base) == {"system_prompt": f"{base}/dental/{profiles.PROMPT}", "glossary": "g.jsonl"}
    assert profiles.assets(found, "empty", base=base) == profiles.assets(found, "gone", base=base) == profiles.assets(found, "", base=base) == {"system_prompt": None, "glossary": None}
    for n in ("b.pdf", "a.pdf", "a-vi.pdf", "c.txt"):
        (tmp_path / n).write_text("x")
    assert [(r.name, r.n) for r in profiles.chapter_files(spark, base).orderBy("n").collect()] == [("a.pdf", 1), ("b.pdf", 2)]
