"""Names of fields, and checks of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def field_type(df: DataFrame, path: str) -> T.DataType | None:
    """Type of the field at a dotted path, through structs and lists of structs; None if there is none."""
    kind: T.DataType = df.schema
    for name in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def data_field(df: DataFrame, name: str, labels: str | None = None) -> tuple[str, bool]:
    """A field's name without the prefix of its label list, and whether it exists.

    ``labels`` is the list that holds it, if any; the name may start with it.  A
    dotted name must lie in an existing struct.
    """
    if not isinstance(name, str):
        raise ValueError(f"a field's name is text, not {name!r}")
    if labels is not None:
        name = name.removeprefix(labels + ".")
    full = name if labels is None else f"{labels}.{name}"
    root = full.rsplit(".", 1)[0]
    if "." in full and field_type(df, root) is None:
        raise ValueError(f"{name!r}: there is no field {root!r}")
    return name, field_type(df, full) is not None


def check_scalar_field(df: DataFrame, value: str | Column) -> None:
    """A field with one value a row: none inside a list (a vector is one value)."""
    if not isinstance(value, str):
        return
    kind: T.DataType = df.schema
    for name in value.split("."):
        if isinstance(kind, T.ArrayType):
            raise ValueError(f"{value!r} lies in a list")
        if isinstance(kind, T.StructType) and name in kind.names:
            kind = kind[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        raise ValueError(f"{value!r} is a list")


def check_labels(df: DataFrame, labels: str, *, needs: tuple[str, ...] = ("id",), view_of: str | tuple[str, ...] | None = None, frames: bool = False) -> None:
    """A list of labels (or one label) with the fields ``needs``.

    ``view_of`` names the lists that ``df`` was flattened from, if it was: a
    single one, or those of truth and predictions.  Labels of frames must be
    turned into rows first.
    """
    if frames:
        raise ValueError("labels of frames aren't supported: make every frame a row first")
    if view_of is not None and labels not in ((view_of,) if isinstance(view_of, str) else view_of):
        raise ValueError(f"these rows are labels of {view_of!r}, not of {labels!r}")
    kind = field_type(df, labels)
    if kind is None:
        raise ValueError(f"there is no field {labels!r}")
    item = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(item, T.StructType) or not set(needs) <= set(item.names):
        raise ValueError(f"{labels!r} holds {item.simpleString()}; labels need {', '.join(needs)}")
