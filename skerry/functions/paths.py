"""Source-path parsing: rules over slash-separated record paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Data sets whose job names follow a rule of their own, and its pattern.
FAMILY_RULES = (
    ("orbnet_denali", r"^(orbnet_[A-Za-z0-9]+)_conformers_"),
    ("trans1x", r"^(t1x_rxn\d+)_"),
    ("ml_mo", r"^(mo_md_\w+?_\d+)_"),
)


def parsed(path: Column, charge: Column, spin: Column) -> Column:
    """top, group, job, family and step of a record's path, charge and spin.

    A trailing file (with a dot) is dropped, then a trailing stepN gives the step (else -1). Of the rest, top is the
    first part, job the last one and group all but the last; all are empty, as the family is, where nothing is left.
    """
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    last = F.get(parts, F.size(parts) - 1)
    dirs = F.when(F.contains(last, F.lit(".")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    tail = F.get(dirs, F.size(dirs) - 1)
    step = F.when(F.rlike(tail, F.lit(r"^step\d+$")), F.regexp_extract(tail, r"^step(\d+)$", 1).cast("int"))
    rest = F.when(step.isNotNull(), F.slice(dirs, 1, F.size(dirs) - 1)).otherwise(dirs)
    top, job = F.coalesce(F.get(rest, F.lit(0)), F.lit("")), F.coalesce(F.get(rest, F.size(rest) - 1), F.lit(""))
    group = F.when(F.size(rest) > 1, F.array_join(F.slice(rest, 1, F.size(rest) - 1), "/")).otherwise("")
    return F.struct(top.alias("top"), group.alias("group"), job.alias("job"), family(top, job, charge, spin).alias("family"), F.coalesce(step, F.lit(-1)).alias("step"))


def family(top: Column, job: Column, charge: Column, spin: Column) -> Column:
    """top/name: the name by the data set's own rule, else the job without the record's _charge_spin.

    That pair may be followed by a number, which then goes too; a job that ends otherwise stays whole.
    """
    own = F.concat(F.lit("_"), charge.cast("int").cast("string"), F.lit("_"), spin.cast("int").cast("string"))
    stripped = F.regexp_replace(job, r"_\d+$", "")
    without = lambda name: F.endswith(name, own) & (F.length(name) > F.length(own))
    cut = lambda name: F.substring(name, F.lit(1), F.length(name) - F.length(own))
    key = F.when(without(job), cut(job)).when(without(stripped), cut(stripped)).otherwise(job)
    for name, pattern in FAMILY_RULES:
        key = F.when((top == name) & F.rlike(job, F.lit(pattern)), F.regexp_extract(job, pattern, 1)).otherwise(key)
    return F.when(top == "", F.lit("")).otherwise(F.concat_ws("/", top, key))
