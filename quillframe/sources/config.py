"""Settings: a YAML file, its parts, and what they come to for each file.

Scalars are read as text and cast where they are used, so that ``off`` stays a
severity. Unknown keys are ignored. Profiles are known on the driver, so what a
file gets is a column expression over its path and a constant table of profiles by folder: no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, table_of
from ..operators import lexicon
from .globs import folder_of, glob_regex

try:
    import yaml
except ImportError:  # settings can still be made in code
    yaml = None

#: Looked for in the working folder when no settings file is named.
DEFAULT_FILE = ".quillframe.yaml"
DEFAULT_INCLUDE = ["**/*.md"]
MODES, SEVERITIES = ("procedure", "descriptive"), ("off", "warn", "error")
#: The knobs of the rules and their defaults. Fixed values.
KNOBS = {
    "max_words_procedure": 20,
    "max_words_descriptive": 25,
    "allow_semicolons": False,
    "allow_contractions": False,
    "max_sentences_paragraph": 6,
    "passive_voice": "warn",
    "complex_verb": "warn",
    "ing_form": "warn",
}


class ConfigError(ValueError):
    """Settings or a dictionary that cannot be read."""


@dataclass
class Profile:
    glob: str
    mode: str | None = None
    rules: dict = field(default_factory=dict)
    allow: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    allow_in_phrase: list[str] = field(default_factory=list)


@dataclass
class DictionaryConfig:
    enabled: bool = True
    file: str | None = None
    disallow: dict = field(default_factory=dict)
    allow: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    allow_in_phrase: list[str] = field(default_factory=list)
    use_embedded: bool = True


@dataclass
class Config:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    default_mode: str = "descriptive"
    profiles: list[Profile] = field(default_factory=list)
    rules: dict = field(default_factory=dict)
    dictionary: DictionaryConfig = field(default_factory=DictionaryConfig)
    folder: str = "."

    def all_rules(self) -> dict:
        return KNOBS | self.rules


def _read(path: str) -> dict:
    if yaml is None:
        raise ConfigError("PyYAML is needed to read YAML files")
    try:
        text = Path(path).read_text(encoding="utf-8-sig")
    except OSError as e:
        raise ConfigError(f"{path} cannot be read: {e}") from e
    try:
        found = yaml.load(text, Loader=yaml.BaseLoader)
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is not valid YAML: {e}") from e
    if found in (None, ""):
        return {}
    if not isinstance(found, dict):
        raise ConfigError(f"{path} must hold a mapping")
    return found


def _choice(value: str, choices: tuple[str, ...], what: str) -> str:
    if value.lower() not in choices:
        raise ConfigError(f"{what} must be one of {', '.join(choices)}, not {value!r}")
    return value.lower()


def _flag(value: str, what: str) -> bool:
    return _choice(value, ("true", "false"), what) == "true"


def _list(value) -> list[str]:
    return [str(x) for x in value] if isinstance(value, list) else []


def _rules(found) -> dict:
    """The knobs that are set, with their types."""
    out = {}
    for knob, default in KNOBS.items():
        name = knob.replace("_", "-")
        value = (found or {}).get(name) if isinstance(found, dict) else None
        if value in (None, ""):
            continue
        if isinstance(default, bool):
            out[knob] = _flag(value, name)
        elif isinstance(default, int):
            try:
                out[knob] = int(value)
            except ValueError as e:
                raise ConfigError(f"{name} must be a whole number, not {value!r}") from e
        else:
            out[knob] = _choice(value, SEVERITIES, name)
    return out


def parse_dictionary(found: dict) -> list[tuple]:
    """(term, senses) rows from ``term: [{pos, alternatives, note}]``; an empty entry keeps no senses."""
    out = []
    for term, senses in found.items():
        own = [s for s in senses if isinstance(s, dict)] if isinstance(senses, list) else []
        out.append((str(term), tuple((_choice(s.get("pos") or "any", lexicon.PARTS, f"pos of {term}"), tuple(_list(s.get("alternatives"))), s.get("note") or None) for s in own)))
    return out


def load(path: str | None) -> Config:
    """Settings of a file; the defaults where ``path`` is None or the file is empty."""
    if path is None:
        return Config()
    found = _read(path)
    mapping = lambda v: v if isinstance(v, dict) else {}
    profiles = []
    for p in found.get("profiles") or []:
        own = mapping(p.get("dictionary"))
        profiles.append(Profile(p.get("glob", ""), _choice(p["mode"], MODES, "mode") if p.get("mode") else None, _rules(p.get("rules")), _list(own.get("allow")), _list(own.get("ignore")), _list(own.get("allow-in-phrase"))))
    own = mapping(found.get("dictionary"))
    flag = lambda name: _flag(own[name], name) if own.get(name) else True
    words = DictionaryConfig(flag("enabled"), own.get("file") or None, mapping(own.get("disallow")), _list(own.get("allow")), _list(own.get("ignore")), _list(own.get("allow-in-phrase")), flag("use-embedded"))
    mode = _choice(found["default-mode"], MODES, "default-mode") if found.get("default-mode") else "descriptive"
    return Config(_list(found.get("include")), _list(found.get("exclude")), mode, profiles, _rules(found.get("rules")), words, str(Path(path).resolve().parent))


def resolve_path(explicit: str | None, folder: str = ".") -> str | None:
    """The named file as it is; else the default one if it is there; else None."""
    if explicit:
        return explicit
    own = Path(folder) / DEFAULT_FILE
    return str(own) if own.exists() else None


def dictionary(spark: SparkSession, config: Config) -> DataFrame:
    """The embedded, the project's and the inline entries merged, without terms allowed everywhere."""
    own, layers = config.dictionary, []
    if own.use_embedded:
        layers.append(lexicon.embedded(spark))
    if own.file:
        path = Path(config.folder) / own.file
        if not path.exists():
            raise ConfigError(f"the dictionary file {path} is missing")
        layers.append(lexicon.table(spark, parse_dictionary(_read(str(path)))))
    layers.append(lexicon.table(spark, parse_dictionary(own.disallow)))
    return lexicon.merged(*layers, removed=(*own.allow, *own.ignore))


def _setting(p: Profile, place: int) -> dict:
    lower = lambda words: [w.lower() for w in words]
    return {"folder": folder_of(p.glob), "place": place, "regex": glob_regex(p.glob), "mode": p.mode, "allow": lower(p.allow + p.ignore), "phrases": lower(p.allow_in_phrase)} | {k: p.rules.get(k) for k in KNOBS}


_KINDS = {bool: "boolean", int: "int", str: "string"}
_PROFILE = "folder string, place int, regex string, mode string, allow array<string>, phrases array<string>, " + ", ".join(f"{k} {_KINDS[type(v)]}" for k, v in KNOBS.items())


def matching(file: Column, config: Config) -> Column:
    """The profiles whose glob matches a path, in their order.

    A profile is looked up by the folder that its glob names before any wildcard, among the folders of the path; so of
    thousands of profiles only those are tried by pattern that could match.
    """
    found = table_of([_setting(p, i) for i, p in enumerate(config.profiles)], "folder", _PROFILE)
    parts = F.split(F.lower(file), "/", -1)
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = F.filter(F.flatten(F.transform(folders, found)), lambda p: F.rlike(file, p["regex"]))
    return F.array_sort(F.transform(hits, lambda p: F.struct(p["place"].alias("place"), p.alias("p"))))


def _last(profiles: Column, knob: str) -> Column:
    return F.try_element_at(F.filter(profiles, lambda x: x["p"][knob].isNotNull()), F.lit(-1))["p"][knob]


def _settings(profiles: Column, config: Config) -> Column:
    """What matching profiles come to: the first mode, the last value of each knob, all words."""

    def union(general: list[str], name: str) -> Column:
        own = F.array(*(F.lit(t.lower()) for t in general)).cast("array<string>")
        return F.array_distinct(F.concat(own, F.flatten(F.transform(profiles, lambda x: x["p"][name]))))

    own = config.dictionary
    return F.struct(
        F.coalesce(F.get(F.filter(profiles, lambda x: x["p"]["mode"].isNotNull()), 0)["p"]["mode"], F.lit(config.default_mode)).alias("mode"),
        F.struct(*(F.coalesce(_last(profiles, k), F.lit(v)).alias(k) for k, v in config.all_rules().items())).alias("rules"),
        union(own.allow + own.ignore, "allow").alias("allowed"),
        union(own.allow_in_phrase, "phrases").alias("phrases"),
    )


def all_phrases(config: Config) -> list[str]:
    every = config.dictionary.allow_in_phrase + [t for p in config.profiles for t in p.allow_in_phrase]
    return sorted({t.lower() for t in every})


def resolved(df: DataFrame, config: Config, file: str = "file") -> DataFrame:
    """Adds mode, rules, allowed and phrases to rows with a path; a null path gets the general ones."""
    path = F.coalesce(F.col(file), F.lit(""))
    none = F.expr(f"cast(array() as array<struct<place:int,p:struct<{_PROFILE}>>>)")
    found = F.when(F.col(file).isNull(), none).otherwise(matching(path, config)) if config.profiles else none
    return df.withColumn("_settings", let(found, lambda p: _settings(p, config))).withColumns({c: F.col(f"_settings.{c}") for c in ("mode", "rules", "allowed", "phrases")}).drop("_settings")
