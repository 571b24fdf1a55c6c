import random
import re
import time

import pytest

from quillframe.operators import lexicon
from quillframe.sources import config as settings
from quillframe.sources.config import Config, ConfigError, DictionaryConfig, Profile, resolved
from quillframe.sources.files import UnsafePathError, read_files, safe_join
from quillframe.sources.globs import glob_regex, selects

FULL = """
include: [docs/**/*.md]
exclude: [docs/**/generated/**]
default-mode: procedure
unknown: 1
profiles:
  - glob: docs/a/**/*.md
    mode: descriptive
    rules: {passive-voice: off, max-words-procedure: 12}
    dictionary: {allow: [shall], ignore: [api], allow-in-phrase: [fuel mix]}
rules: {max-words-descriptive: 30, allow-semicolons: true}
dictionary:
  enabled: true
  use-embedded: false
  file: own.yaml
  disallow:
    utilize: [{pos: verb, alternatives: [use]}]
  allow: [prior to]
"""


def test_full_settings(tmp_path, spark):
    (tmp_path / "c.yaml").write_text(FULL)
    (tmp_path / "own.yaml").write_text("commence: [{pos: verb, alternatives: [start], note: n, other: 1}]\nnothing:\nprior to: [{}]\n")
    c = settings.load(str(tmp_path / "c.yaml"))
    assert (c.include, c.exclude, c.default_mode) == (["docs/**/*.md"], ["docs/**/generated/**"], "procedure")
    assert c.profiles == [Profile("docs/a/**/*.md", "descriptive", {"max_words_procedure": 12, "passive_voice": "off"}, ["shall"], ["api"], ["fuel mix"])]
    assert c.rules == {"max_words_descriptive": 30, "allow_semicolons": True}
    got = {r["term"]: r["senses"] for r in settings.dictionary(spark, c).collect()}
    assert sorted(got) == ["commence", "nothing", "utilize"] and got["nothing"] == []


def test_defaults_and_errors(tmp_path, spark):
    assert settings.load(None) == Config()
    (tmp_path / "e.yaml").write_text("# nothing\n")
    assert settings.load(str(tmp_path / "e.yaml")).rules == {}
    for text in ("a: [", "rules: {ing-form: loud}", "rules: {max-words-procedure: x}", "- list"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ConfigError):
            settings.load(str(tmp_path / "bad.yaml"))
    with pytest.raises(ConfigError):
        settings.load(str(tmp_path / "missing.yaml"))
    with pytest.raises(ConfigError):
        settings.dictionary(spark, Config(dictionary=settings.DictionaryConfig(file="missing.yaml"), folder=str(tmp_path)))
    assert settings.resolve_path(None, str(tmp_path)) is None and settings.resolve_path("x.yaml") == "x.yaml"


def test_resolution(docs):
    config = Config(
        profiles=[Profile("a/**", rules={"ing_form": "error"}, allow=["X"]), Profile("a/b/*", mode="procedure", rules={"ing_form": "off"}, allow=["x", "Y"]), Profile("**/c.md", mode="descriptive")],
    )
    got = {r["file"]: r for r in settings.resolved(docs(("a/b/c.md", ""), ("A/z/c.md", ""), ("q.md", "")), config).collect()}
    assert [(got[f]["mode"], got[f]["rules"]["ing_form"], got[f]["allowed"]) for f in ("a/b/c.md", "A/z/c.md", "q.md")] == [("procedure", "off", ["x", "y"]), ("descriptive", "error", ["x"]), ("descriptive", "warn", [])]


def test_globs():
    assert selects("docs/a/b.md", ["docs/**/*.md"], []) and selects("docs/b.MD", ["docs/**/*.md"], [])
    assert not selects("docs/x/generated/b.md", ["docs/**/*.md"], ["docs/**/generated/**"]) and not selects("a/b.md", ["*.md"], [])


def test_files(tmp_path, spark):
    for name, text in {"a.md": "﻿One.", "d/b.md": "Two.", "d/gen/c.md": "Three.", "n.txt": "no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    names = lambda **k: sorted(r["file"] for r in read_files(spark, str(tmp_path), **k).collect())
    assert names() == ["a.md", "d/b.md", "d/gen/c.md"]
    assert names(config=Config(include=["d/**"], exclude=["d/gen/**"])) == ["d/b.md"]
    assert names(config=Config(include=["d/**"]), globs=["*.txt"]) == ["n.txt"]
    with pytest.raises(UnsafePathError):
        safe_join(str(tmp_path), "../x")
    assert safe_join(str(tmp_path), "d/b.md").endswith("d/b.md")


def test_seed(spark):
    rows = lexicon.embedded(spark).collect()
    assert len({r["term"] for r in rows}) == len(rows) and all(s["pos"] in lexicon.PARTS for r in rows for s in r["senses"])


def test_thousands_of_profiles(spark):
    """Five thousand profiles plan in seconds, and come to what a plain reading of them does."""
    r = random.Random(4)
    part = lambda: r.choice(["a", "B", "c1", "d"])
    shapes = [lambda: f"{part()}/**", lambda: f"{part()}/{part()}/*.md", lambda: f"{part()}/x{r.randrange(2000)}/**", lambda: f"{part()}*/{part()}/**/*.md", lambda: "**/n%d.md" % r.randrange(3), lambda: f"./{part()}\\{part()}\\", lambda: f"{part()}/y*/z.md"]
    profiles = []
    for i in range(5000):
        glob = r.choice(shapes)() if i % 25 == 0 else shapes[2]()
        profiles.append(Profile(glob, r.choice([None, "procedure", "descriptive"]), r.choice([{}, {"max_words_procedure": i}, {"ing_form": "off", "allow_semicolons": True}]), [f"T{i % 7}"], [], [f"P {i % 5}"] if i % 3 else []))
    config = Config(profiles=profiles, dictionary=DictionaryConfig(allow=["X"]))
    files = ["a/b/n1.md", "B/x17/q.md", "c1/d/e/f.md", "d/y7/z.md", "n2.md", "A/B/k.MD", "other", "", None] + [f"{part()}/x{r.randrange(2000)}/t.md" for _ in range(60)]
    began = time.time()
    got = resolved(spark.createDataFrame([(f,) for f in files], "file string"), config).collect()
    assert time.time() - began < 60
    for f, row in zip(files, got):
        own = [p for p in profiles if f is not None and re.match(glob_regex(p.glob), f)]
        knobs = config.all_rules()
        for p in own:
            knobs |= p.rules
        assert row["mode"] == next((p.mode for p in own if p.mode), "descriptive") and row["rules"].asDict() == knobs
        assert row["allowed"] == list(dict.fromkeys(["x", *(t.lower() for p in own for t in p.allow)]))
        assert row["phrases"] == list(dict.fromkeys(t.lower() for p in own for t in p.allow_in_phrase))
