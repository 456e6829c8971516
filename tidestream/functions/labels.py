"""The label domain, and names made short and unique."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The classes, in the order of the model's outputs.
LABELS = (
    "Detritus",
    "Phyto_diatom",
    "Phyto_diatom_chaetocerotanae_Chaetoceros",
    "Phyto_diatom_rhisoleniales_Guinardia flaccida",
    "Phyto_diatom_rhisoleniales_Rhizosolenia",
    "Phyto_dinoflagellate_gonyaulacales_Tripos",
    "Phyto_dinoflagellate_gonyaulacales_Tripos macroceros",
    "Phyto_dinoflagellate_gonyaulacales_Tripos muelleri",
    "Zoo_cnidaria",
    "Zoo_crustacea_copepod",
    "Zoo_crustacea_copepod_calanoida",
    "Zoo_crustacea_copepod_calanoida_Acartia",
    "Zoo_crustacea_copepod_calanoida_Centropages",
    "Zoo_crustacea_copepod_cyclopoida",
    "Zoo_crustacea_copepod_cyclopoida_Oithona",
    "Zoo_crustacea_copepod_nauplii",
    "Zoo_other",
    "Zoo_tintinnidae",
)
#: Most characters of a label's key.
KEY_LENGTH = 30
DIGITS = "0123456789"


def unique_keys(labels: Iterable[str], length: int = KEY_LENGTH) -> list[str]:
    """Each label cut to `length`; where that is taken, its last character gives way to the first free number."""
    taken: dict[str, None] = {}
    for label in labels:
        stem = label[:length]
        numbered = (f"{stem[: length - 1]}{n}" for n in range(1, len(taken) + 2))
        taken[stem if stem not in taken else next(k for k in numbered if k not in taken)] = None
    return list(taken)


LABEL_KEYS = tuple(unique_keys(LABELS))


def _numbered(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows (label, cut, family) sorted by family and label, with keys. All numbers of a stem below its next one are taken, so what is
    held of a family is that number for each stem, and the cuts that were free."""
    family, following, own = None, {}, set()

    def taken(name: str) -> bool:
        digits = len(name) - len(name.rstrip(DIGITS))
        splits = ((name[: len(name) - k], name[len(name) - k :]) for k in range(1, digits + 1))
        return name in own or any(not n.startswith("0") and int(n) < following.get(stem, 1) for stem, n in splits)

    for frame in frames:
        keys = []
        for cut, of in zip(frame["__cut"], frame["__family"], strict=True):
            if of != family:
                family, following, own = of, {}, set()
            stem = cut[: length - 1]
            if cut and cut[-1] in DIGITS and not taken(cut):
                own.add(cut)
                keys.append(cut)
                continue
            n = following.get(stem, 1)
            while taken(f"{stem}{n}"):
                n += 1
            following[stem] = n + 1
            keys.append(f"{stem}{n}")
        yield pd.DataFrame({"__label": frame["__label"], "key": keys})


def unique_key_column(labels: DataFrame, label: str, length: int = KEY_LENGTH) -> DataFrame:
    """labels (distinct values of one column) with `key`: what `unique_keys` gives for them in alphabetic order; null has none.

    A cut that doesn't end in a digit can only be wanted by labels of the same cut, so the first of these has it. What is left wants names of
    one stem and a number: labels whose stems differ in digits at their end alone are a family, and no two families can want the same name.
    Families are settled side by side, each label after label as it must be, without holding its rows."""
    cut = F.left(F.col("__label"), F.lit(length))
    rows = labels.select(F.col(label).alias("__label")).filter("__label is not null").withColumn("__cut", cut)
    first = F.row_number().over(Window.partitionBy("__cut").orderBy("__label")) == 1
    rows = rows.withColumn("__settled", first & ~F.col("__cut").rlike("[0-9]$"))
    family = F.regexp_replace(F.left("__cut", F.lit(length - 1)), "[0-9]+$", "")
    open_ = rows.filter("not __settled").select("__label", "__cut", family.alias("__family"))
    numbered = open_.repartition("__family").sortWithinPartitions("__family", "__label").mapInPandas(lambda it: _numbered(it, length), "__label string, key string")
    keys = rows.filter("__settled").select("__label", F.col("__cut").alias("key")).unionByName(numbered)
    return labels.join(keys, F.col(label) == F.col("__label"), "left").drop("__label")


def group_of(label: Column, patterns: dict[str, str], default: str = "Other") -> Column:
    """The group of the first pattern that a label matches, wholly or, where the pattern ends in `*`, by its start.

    For a handful of patterns; see operators.joins.label_groups for a table of them."""
    out = F.lit(None).cast("string")
    for pattern, group in patterns.items():
        hit = F.startswith(label, F.lit(pattern[:-1])) if pattern.endswith("*") else label == F.lit(pattern)
        out = F.coalesce(out, F.when(hit, F.lit(group)))
    return F.coalesce(out, F.lit(default))
