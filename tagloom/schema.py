"""The label schema: ordered labels with mode, category, subcategory and exclusion group, and its content hash."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MODES = ("pn", "pu", "unsupported")


def canonical_sha256(value: object, without: tuple[str, ...] = ()) -> str:
    """SHA-256 of compact UTF-8 JSON with sorted keys, optionally without some top-level keys."""
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if k not in without}
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class LabelSchema:
    """A checked schema; small by nature, so it lives on the driver and becomes dimension tables."""

    version: str
    labels: tuple[str, ...]
    modes: dict[str, str]
    categories: dict[str, dict[str, list[str]]]
    exclusive: dict[str, list[str]] = field(default_factory=dict)
    implications: tuple[dict, ...] = ()
    sha256: str = ""

    @staticmethod
    def from_json(doc: dict) -> LabelSchema:
        """Checks the document and builds the schema; any break of its rules raises ``ValueError``."""
        labels = tuple(doc["labels"])
        if len(set(labels)) != len(labels) or doc.get("num_labels", len(labels)) != len(labels):
            raise ValueError("labels must be unique and as many as stated")
        modes = dict(doc["label_training_modes"])
        if set(modes) != set(labels) or not set(modes.values()) <= set(MODES):
            raise ValueError("every label needs one of the modes " + ", ".join(MODES))
        if sorted(doc.get("unsupported_labels", [])) != sorted(t for t in labels if modes[t] == "unsupported"):
            raise ValueError("unsupported labels differ from the modes")
        placed = [t for subs in doc["semantic_categories"].values() for tags in subs.values() for t in tags]
        if sorted(placed) != sorted(labels):
            raise ValueError("the categories must hold every label once")
        groups = dict(doc.get("safe_mutual_exclusion_groups", {}))
        members = [t for g in groups.values() for t in g]
        if len(set(members)) != len(members) or not set(members) <= set(labels):
            raise ValueError("exclusion groups must be disjoint sets of labels")
        own = canonical_sha256(doc, without=("schema_sha256",))
        if doc.get("schema_sha256", own) != own:
            raise ValueError("the schema's hash does not match its content")
        return LabelSchema(doc.get("schema_version", ""), labels, modes, doc["semantic_categories"], groups, tuple(doc.get("implication_rules", ())), own)

    @staticmethod
    def load(path: str) -> LabelSchema:
        with open(path, encoding="utf-8") as f:
            return LabelSchema.from_json(json.load(f))

    def label_dim(self, spark: SparkSession) -> DataFrame:
        where = {t: (c, s) for c, subs in self.categories.items() for s, tags in subs.items() for t in tags}
        group = {t: g for g, tags in self.exclusive.items() for t in tags}
        return spark.createDataFrame([(i, t, self.modes[t], *where[t], group.get(t)) for i, t in enumerate(self.labels)], "idx int, tag string, mode string, category string, subcategory string, excl_group string")
