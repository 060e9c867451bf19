"""Declared schemas: attributes with types, bounds and processing metadata; JSON loading; StructType conversion."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import types as T

#: Type tag to Spark type; all semantic string tags (name, zip, currency ...) are strings.
SPARK_TYPES = {
    "int": T.IntegerType(),
    "numericBoolean": T.IntegerType(),
    "long": T.LongType(),
    "epochTime": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "stringComp": T.ArrayType(T.StringType()),
    "geoLocation": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
}

#: JSON names of the declared properties, beside their names here.
JSON_NAMES = {
    "dataType": "data_type", "datePattern": "date_pattern", "stdDev": "std_dev", "maxZscore": "max_zscore", "stringPattern": "pattern", "stringPatternName": "pattern_name",
    "minString": "min_string", "maxString": "max_string", "earliestDate": "earliest", "latestDate": "latest", "targetFieldOrdinals": "targets", "buckeWidth": "bucket_width",
    "bucketWidth": "bucket_width", "normalizerStrategy": "normalizer",
}


@dataclass(frozen=True)
class Attribute:
    name: str
    ordinal: int
    data_type: str = "string"
    id: bool = False
    min: float | None = None
    max: float | None = None
    min_string: str | None = None
    max_string: str | None = None
    length: int | None = None
    earliest: str | None = None
    latest: str | None = None
    mean: float | None = None
    std_dev: float | None = None
    skew: float | None = None
    max_zscore: float | None = None
    nullable: bool = True
    pattern: str | None = None
    pattern_name: str | None = None
    date_pattern: str | None = None
    bucket_width: float | None = None
    normalizer: str | None = None
    cardinality: tuple[str, ...] = ()
    transformers: tuple[str, ...] = ()
    validators: tuple[str, ...] = ()
    targets: tuple[int, ...] = ()

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES.get(self.data_type, T.StringType())


@dataclass(frozen=True)
class Schema:
    attributes: tuple[Attribute, ...]
    generators: tuple[Attribute, ...] = ()
    row_validators: tuple[str, ...] = ()
    names: dict[int, str] = field(default_factory=dict, compare=False)

    def __getitem__(self, key: int | str) -> Attribute:
        found = [a for a in self.attributes if key in (a.name, a.ordinal)]
        if not found:
            raise KeyError(key)
        return found[0]

    def struct_type(self) -> T.StructType:
        """The Spark schema in ordinal order, with the semantic tag as field metadata."""
        return T.StructType([T.StructField(a.name, a.spark_type, a.nullable, {"tag": a.data_type}) for a in sorted(self.attributes, key=lambda a: a.ordinal)])

    def check_targets(self) -> None:
        """Targets of attributes and generators must cover 0 .. n - 1, each exactly once."""
        targets = sorted(t for a in (*self.attributes, *self.generators) for t in a.targets)
        if targets != list(range(len(targets))):
            raise ValueError(f"target fields must be 0 to {len(targets) - 1}, once each: {targets}")


def attribute(data: dict[str, Any]) -> Attribute:
    known = {f.name for f in fields(Attribute)}
    values = {JSON_NAMES.get(k, k): v for k, v in data.items()}
    return Attribute(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def load(text: str) -> Schema:
    """A schema from JSON text; unknown properties are ignored. Generators without ordinal get -1."""
    data = json.loads(text)
    listed = data.get("attributes") or data.get("fields") or []
    made = [attribute({"ordinal": -1, "name": f"generated{i}"} | g) for i, g in enumerate(data.get("attributeGenerators") or [])]
    return Schema(tuple(attribute(a) for a in listed), tuple(made), tuple(data.get("rowValidators") or ()))
