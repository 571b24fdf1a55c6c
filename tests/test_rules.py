import pytest

from quillframe.operators import rules
from quillframe.plans.lint import prepared
from quillframe.sources.config import Config, Profile

WORDS = " ".join(["word"] * 22) + "."
CASES = [
    (" ".join(["word"] * 26) + ".", {}, ["STE100-4.1"]),
    (" ".join(["word"] * 25) + ".", {}, []),
    (WORDS, {}, []),
    (WORDS, {"mode": "procedure"}, ["STE100-4.1"]),
    ("Open the panel; then close; it.", {}, ["STE100-8.1"]),
    ("Open the panel; then close it.", {"allow_semicolons": True}, []),
    ("Use `a;b` now.", {}, []),
    ("It's the project's door.", {}, ["STE100-4.2"]),
    ("We don't and can't.", {}, ["STE100-4.2", "STE100-4.2"]),
    ("We don't.", {"allow_contractions": True}, []),
    ("Use `don't` now.", {}, []),
    ("One. Two. Three. Four. Five. Six. Seven.", {}, ["STE100-ADV-PARA"]),
    ("One. Two. Three. Four. Five. Six. Seven.", {"max_sentences_paragraph": 0}, []),
    ("- One. Two. Three. Four. Five. Six. Seven.", {}, []),
    ("The valve is opened daily.", {}, ["STE100-ADV-PASSIVE"]),
    ("The valve is opened daily.", {"passive_voice": "off"}, []),
    ("The valve has been opened now.", {}, ["STE100-ADV-COMPLEXVERB"]),
    ("You should have opened it.", {}, ["STE100-ADV-COMPLEXVERB"]),
    ("Use `is opened` and `has opened` now.", {}, []),
    ("We like testing here.", {}, ["STE100-ADV-INGFORM"]),
    ("Use config.testing or testing.py now, being able.", {}, []),
    ("We end by testing.", {}, []),
    ("We like testing here.", {"ing_form": "off"}, []),
]


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    for i, (text, knobs, _) in enumerate(CASES):
        knobs = dict(knobs)
        mode = knobs.pop("mode", "descriptive")
        out[i] = (text, Config(default_mode=mode, rules=knobs))
    results = {}
    groups = {}
    for i, (text, config) in out.items():
        groups.setdefault(repr(config), (config, []))[1].append((str(i), text))
    for config, rows in groups.values():
        frame = spark.createDataFrame(rows, "file string, content string")
        for r in rules.structural(prepared(frame, config)).orderBy("file", "seg_ord", "rank", "offset").collect():
            results.setdefault(int(r["file"]), []).append(r)
    return results


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(found, i):
    assert [r["rule_code"] for r in found.get(i, [])] == CASES[i][2]


def test_severity_and_text(spark, docs):
    config = Config(rules={"passive_voice": "error"})
    row = rules.structural(prepared(docs("First.\nThe valve is opened " + "x" * 90 + "."), config), "passive_voice").first()
    assert (row["severity"], row["line"]) == ("error", 2)
    assert row["message"].endswith('..."') and len(row["message"].split('"')[1]) == 80


def test_profiles_by_file(docs):
    config = Config(profiles=[Profile("proc/**", mode="procedure")])
    got = rules.structural(prepared(docs(("proc/a.md", WORDS), ("b.md", WORDS)), config)).collect()
    assert [(r["file"], r["rule_code"]) for r in got] == [("proc/a.md", "STE100-4.1")]
