"""Fixed schemas of the two JSON-lines feeds and of the tables built from them."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _BOOL = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


IMPORT_ITEM = _struct(name=_STRING, isPublic=_BOOL, isDeprecated=_BOOL)

DECLARATION_ITEM = _struct(
    name=_STRING, shortName=_STRING, kind=_STRING, namespace=_STRING, sourceFile=_STRING,
    startLine=_LONG, endLine=_LONG, sourceText=_STRING, docstring=_STRING,
    attrs=T.ArrayType(_STRING), isProtected=_BOOL, isExternal=_BOOL, isDeprecated=_BOOL,
    deprecatedSince=T.DateType(),
)

MODULE_FEED = _struct(
    seq=_LONG, module=_STRING, path=_STRING, docstring=_STRING, title=_STRING,
    tags=T.ArrayType(_STRING), authors=T.ArrayType(_STRING), isDeprecated=_BOOL,
    imports=T.ArrayType(IMPORT_ITEM), namespaces=T.ArrayType(_STRING),
    declarations=T.ArrayType(DECLARATION_ITEM),
)

DEP_ITEM = _struct(name=_STRING, inType=_BOOL, inValue=_BOOL)
EXTENDS_ITEM = _struct(parent=_STRING, position=_LONG)
MEMBER_ITEM = _struct(name=_STRING, position=_LONG)
DEPRECATED_BY = _struct(replacement=_STRING, message=_STRING, since=_STRING)

EXTRACT_FEED = _struct(
    seq=_LONG, name=_STRING, typeSignature=_STRING, deps=T.ArrayType(DEP_ITEM),
    extends=T.ArrayType(EXTENDS_ITEM), instantiates=_STRING, instancePriority=_LONG,
    deprecatedBy=DEPRECATED_BY, additiveVersion=_STRING, fields=T.ArrayType(MEMBER_ITEM),
    constructors=T.ArrayType(MEMBER_ITEM), module=_STRING,
)

MODULE_REQUIRED = ("module", "path")
DECLARATION_REQUIRED = (
    "name", "shortName", "kind", "namespace", "sourceFile", "startLine", "endLine", "sourceText",
)
EXTRACT_REQUIRED = ("name", "typeSignature")
# Fields that every item of a list must have for its record to be readable.
MODULE_ITEMS_REQUIRED = {"declarations": DECLARATION_REQUIRED, "imports": ("name",)}
EXTRACT_ITEMS_REQUIRED = {
    "deps": ("name",), "extends": ("parent", "position"), "fields": ("name", "position"),
    "constructors": ("name", "position"),
}

TOPIC = _struct(priority=_LONG, id=_STRING, label=_STRING, y=T.DoubleType(), color=_STRING)
