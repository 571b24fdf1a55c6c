"""The dictionary of terms: layers, overrides and allowances.

A dictionary is a table (term, senses) with senses an array of (pos,
alternatives, note). Layers are merged by the last writer of a term, in either case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENSE = "struct<pos:string,alternatives:array<string>,note:string>"
SENSES = f"array<{SENSE}>"
SCHEMA = f"term string, senses {SENSES}"
PARTS = ("any", "noun", "verb", "adjective", "adverb")

#: A dictionary of our own, a term a line: the term, then for each sense a part of speech and what to write instead.
_SEED = """
abandon: verb stop
abbreviate: verb shorten
absence: noun lack
abundant: adjective many, much
accelerate: verb speed up
accommodate: verb hold, fit
accomplish: verb do, complete
accordingly: adverb thus, so
accumulate: verb collect
accurate: adjective correct
achieve: verb get, do
acquire: verb get
activate: verb start
additional: adjective more
additionally: adverb also
adequate: adjective enough
adhere: verb stick, obey
adjacent: adjective near, next to
adverse: adjective bad
affix: verb attach
a large number of: any many
alleviate: verb decrease
allocate: verb give, assign
a lot of: any much, many
alter: verb change
alternative: noun other option; adjective other
ameliorate: verb improve
amount: noun quantity; verb add up
anomaly: noun fault
anticipate: verb expect
apparatus: noun equipment
apparent: adjective clear
append: verb add
approximately: adverb about
as a consequence of: any because of
ascertain: verb find, make sure
assemble: verb put together
assist: verb help
assistance: noun help
at the present time: any now
at this point in time: any now
attain: verb get
attempt: verb try; noun try
augment: verb increase
beneath: any below
beneficial: adjective useful
by means of: any with, by
capability: noun ability
cease: verb stop
circumvent: verb avoid
cognizant: adjective aware
commence: verb start
commencement: noun start
compel: verb make
competent: adjective able
comprehend: verb understand
comprise: verb have, include
concerning: any about
conceal: verb hide
conclude: verb end
concur: verb agree
configuration: noun setup, arrangement
consequently: adverb thus, so
considerable: adjective large, much
constitute: verb be, make
construct: verb build
consume: verb use
deactivate: verb stop
deem: verb think
defective: adjective damaged
deficient: adjective low
demonstrate: verb show
depart: verb leave, go
deplete: verb use up
depress: verb push
designate: verb name
desire: verb want; noun wish
detach: verb remove
detect: verb find
detrimental: adjective harmful
diminish: verb decrease
disclose: verb show, tell
discontinue: verb stop
disengage: verb release
dispatch: verb send
disseminate: verb send
due to the fact that: any because
duration: noun time
earliest: adjective first
effect: verb make, cause
elapse: verb go by
elevate: verb lift
eliminate: verb remove
elucidate: verb explain
employ: verb use
enable: verb let
encounter: verb find
endeavor: noun try; verb try
energize: verb start
enumerate: verb count, list
equivalent: adjective equal
erroneous: adjective wrong
establish: verb set up
evaluate: verb check
evident: adjective clear
exceed: verb be more than
excessive: adjective too much
exhibit: verb show
expedite: verb hurry
expiration: noun end
fabricate: verb make
facilitate: verb help
feasible: adjective possible
finalize: verb complete
for the purpose of: any for, so that
for the reason that: any because
forward: verb send
frequently: adverb often
function: noun task, role; verb act, run
furnish: verb send, give
furthermore: adverb also
however: adverb but
identical: adjective same
illustrate: verb show
impact: noun result, change; verb change, hit
implement: verb do, start; noun tool
inadvertent: adjective accidental
in accordance with: any as in, by
in addition to: any with, besides
in close proximity to: any near
indicate: verb show
initial: adjective first
initiate: verb start
in lieu of: any instead of
in order to: any to
inquire: verb ask
in spite of: any although
insufficient: adjective not enough
in the event of: any if
in the event that: any if
in the vicinity of: any near
maintain: verb keep
majority: noun most
modify: verb change
moreover: adverb also
necessitate: verb need
notify: verb tell
numerous: adjective many
objective: noun goal
observe: verb look at, see
obtain: verb get
optimum: adjective best
perform: verb do
permit: verb let; noun license
possess: verb have
preceding: adjective earlier
primary: adjective main
prior to: any before
prohibit: verb prevent
purchase: verb buy
regarding: any about
remainder: noun rest
requirement: noun need
retain: verb keep
shall: verb must
subsequent: adjective next, later
subsequently: adverb then, later
subsequent to: any after
sufficient: adjective enough
terminate: verb end, finish
therefore: adverb thus, so
transmit: verb send
utilization: noun use
utilize: verb use
vicinity: noun area
with regard to: any about
"""


def _entry(line: str) -> tuple:
    term, _, senses = line.partition(": ")
    each = (s.partition(" ") for s in senses.split("; "))
    return term, tuple((pos, tuple(told.split(", "))) for pos, _, told in each)


SEED = tuple(map(_entry, _SEED.split("\n")[1:-1]))


def rows(entries) -> list[tuple]:
    """(term, senses) rows from pairs of a term and its (pos, alternatives[, note])."""
    return [(term, [(s[0], list(s[1]), s[2] if len(s) > 2 else None) for s in senses]) for term, senses in entries]


def table(spark: SparkSession, entries) -> DataFrame:
    return spark.createDataFrame(rows(entries), SCHEMA)


def embedded(spark: SparkSession) -> DataFrame:
    return table(spark, SEED)


def merged(*layers: DataFrame, removed: tuple[str, ...] = ()) -> DataFrame:
    """One entry a term: the last layer that has it gives all senses; ``removed`` terms go. Case does not count."""
    stacked = reduce(DataFrame.unionByName, (d.select("term", "senses").withColumn("layer", F.lit(i)).withColumn("ord", F.monotonically_increasing_id()) for i, d in enumerate(layers)))
    last = Window.partitionBy(F.lower("term")).orderBy(F.desc("layer"), F.desc("ord"))
    best = stacked.withColumn("n", F.row_number().over(last)).where("n = 1").select("term", "senses")
    return best.where(~F.lower("term").isin(*(t.lower() for t in removed))) if removed else best


def lookup(dictionary: DataFrame, term: str) -> DataFrame:
    return dictionary.where(F.lower("term") == term.lower())


def lookups(dictionary: DataFrame, asked: DataFrame) -> DataFrame:
    """The entries of the terms in column ``asked``, in any case: its columns, and senses; a term without an entry gives no row."""
    key = lambda c: F.lower(F.col(c))
    return asked.withColumn("_key", key("asked")).join(dictionary.select(key("term").alias("_key"), "senses"), "_key").drop("_key")


def names_itself(sense: Column, term: Column) -> Column:
    return F.exists(sense["alternatives"], lambda a: F.lower(a) == F.lower(term))


def described(dictionary: DataFrame) -> DataFrame:
    """Adds what the checks ask of an entry: key words, and whether it can be acted upon."""
    term, senses = F.col("term"), F.col("senses")
    words = F.split(F.lower(term), " ")
    parts = F.array_distinct(F.transform(senses, lambda s: s["pos"]))
    own = lambda s: names_itself(s, term)
    return dictionary.withColumns(
        {
            "words": words,
            "unactionable": (F.size(senses) >= 2) & (F.size(parts) >= 2) & F.forall(senses, own),
            "self_ref": F.exists(senses, own),
            # senses of any part of speech are left by every guess
            "guessed": (F.size(senses) == 0) | F.exists(senses, own) | F.exists(senses, lambda s: s["pos"] != "any"),
            "term_length": F.length(term),
        }
    )
