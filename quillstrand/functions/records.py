"""Records whose keys are not known beforehand: JSON objects as maps of variants, without a scan for their schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstrand.functions.scores import pooled


def record(text: Column) -> Column:
    """map<string, variant> of a JSON object's text, keys in their order; null for texts that are none. NaN and infinities
    are read as numbers; what follows the object is not looked at."""
    return F.from_json(text, "map<string,variant>")


def field(found: Column, name: str, kind: str = "string") -> Column:
    """A key's value as kind; null where the key is missing, null, or can't be brought to kind."""
    return F.try_variant_get(F.try_element_at(found, F.lit(name)), "$", kind)


def scalars(found: Column, without: list[str]) -> Column:
    """The entries that are numbers, texts, booleans or null, but for the names in without; lists and objects are left out."""
    nested = lambda v: F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)")
    return F.map_filter(found, lambda k, v: ~k.isin(without) & ~nested(v))


def _json(value: Column) -> Column:
    """Numbers and booleans as they are written, null as null; NaN stays NaN, which readers of such files know."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def line(found: Column, values: dict[str, Column]) -> Column:
    """The text of a record with values (numbers or booleans) in place of its entries of those names, or after all others.
    Other entries keep their meaning and order: nested ones, nulls and numbers that differ in kind from row to row."""
    rest = F.to_json(F.map_filter(found, lambda k, v: ~k.isin(list(values))))
    new = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), _json(v)) for k, v in values.items()])
    return F.when(rest == "{}", F.concat(F.lit("{"), new, F.lit("}"))).otherwise(F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(","), new, F.lit("}")))


def vectors(output: Column, how: str = "mean") -> Column:
    """array<array<double>>: the vectors of what a model returned, a variant of nested lists of numbers. A list is one vector, a
    matrix one for each row, a tensor (sequences x tokens x places) one for each sequence, its tokens pooled by mean or
    final. Null stays null; other depths, ragged nesting, empty lists and vectors of different lengths raise an error."""
    if how not in ("mean", "final"):
        raise ValueError(f"unknown pooling: {how}")
    shape = F.schema_of_variant(output)
    deep = lambda n: shape.rlike("^" + "ARRAY<" * n + "(BIGINT|DOUBLE|FLOAT|DECIMAL[^<]*)>+$")
    get = lambda n: F.variant_get(output, "$", "array<" * n + "double" + ">" * n)
    found = F.when(deep(1), F.array(get(1))).when(deep(2), get(2)).when(deep(3), F.transform(get(3), lambda t: pooled(t, how)))
    found = F.coalesce(found, F.raise_error(F.concat(F.lit("not a vector, matrix or tensor: "), shape)).cast("array<array<double>>"))
    checked = F.transform(F.array(found), lambda v: F.when(F.size(F.array_distinct(F.transform(v, F.size))) == 1, v).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("array<array<double>>")))[0]
    return F.when(output.isNotNull(), checked)
