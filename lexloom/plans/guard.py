"""Which SQL of users is run: read queries over the engine's own relations.

A query is judged by its analyzed plan, where every name is resolved: whatever a
query is written like, its leaves are relations and its expressions are functions.
Each leaf must be one of the engine's views (told by its plan, not by its name), a
list of values or no relation at all; each operator and each expression must be on
a list. What is not on a list is refused, so user-defined functions, calls of Java
methods, files, other tables, generated ranges and functions whose result has no
bound in their input (``repeat``, ``sequence``) never run. Analysis runs nothing:
only text that Spark's parser takes as a query gets that far.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Operators of a plan, and leaves that read nothing.
OPERATORS = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "Union", "Distinct", "Except", "Intersect", "SubqueryAlias", "Window", "Generate", "Expand", "WithCTE", "CTERelationDef", "CTERelationRef", "UnresolvedHint", "ResolvedHint"}
EMPTY_LEAVES = {"OneRowRelation", "LocalRelation"}
#: Expressions by the name of their class.
EXPRESSIONS = {
    "Alias", "AttributeReference", "Literal", "OuterReference", "Cast", "SortOrder", "PrettyAttribute", "BoundReference",
    "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "And", "Or", "Not", "In", "InSet", "InSubquery", "ListQuery", "ScalarSubquery", "Exists", "IsNull", "IsNotNull", "IsNaN", "Between",
    "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "Pmod", "UnaryMinus", "UnaryPositive", "Abs", "Round", "BRound", "Floor", "Ceil", "RoundFloor", "RoundCeil", "CeilExpressionBuilder", "Sqrt", "Pow", "Exp", "Log", "Log10", "Log2", "Signum", "Greatest", "Least",
    "With", "CommonExpressionDef", "CommonExpressionRef", "CaseWhen", "If", "Coalesce", "Nvl", "Nvl2", "NullIf", "NaNvl", "TypedNullLiteral",
    "Contains", "StartsWith", "EndsWith", "Like", "ILike", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny", "RLike", "Lower", "Upper", "InitCap", "Substring", "Left", "Right", "Length", "OctetLength", "BitLength", "Concat", "ConcatWs", "StringTrim", "StringTrimLeft", "StringTrimRight", "StringReplace", "StringTranslate", "StringLocate", "StringInstr", "SubstringIndex", "StringSplit", "SplitPart", "Reverse", "Levenshtein", "RegExpExtract", "RegExpExtractAll", "RegExpReplace", "RegExpCount", "RegExpInStr", "RegExpSubStr", "Ascii", "Crc32", "Md5", "Sha1", "Sha2", "XxHash64", "Murmur3Hash",
    "CurrentDate", "CurrentTimestamp", "Year", "Quarter", "Month", "DayOfMonth", "DayOfWeek", "DayOfYear", "WeekOfYear", "LastDay", "DateAdd", "DateSub", "DateDiff", "AddMonths", "MonthsBetween", "TruncDate", "MakeDate", "ParseToDate", "DateFormatClass", "GetTimestamp", "ToDate",
    "CreateArray", "CreateNamedStruct", "CreateMap", "GetStructField", "GetArrayItem", "GetArrayStructFields", "GetMapValue", "ElementAt", "Get", "Size", "ArraySize", "ArrayContains", "ArrayJoin", "ArrayDistinct", "ArrayMax", "ArrayMin", "ArrayPosition", "ArraySort", "SortArray", "Slice", "ArrayUnion", "ArrayIntersect", "ArrayExcept", "ArrayTransform", "ArrayFilter", "ArrayExists", "ArrayForAll", "ArrayAggregate", "LambdaFunction", "NamedLambdaVariable", "Explode", "PosExplode", "Inline", "GeneratorOuter",
    "AggregateExpression", "Count", "CountIf", "Sum", "Average", "Min", "Max", "MinBy", "MaxBy", "First", "Last", "AnyValue", "BoolAnd", "BoolOr", "CollectList", "CollectSet", "ListAgg", "StddevSamp", "StddevPop", "VarianceSamp", "VariancePop", "Median", "Percentile", "ApproximatePercentile", "HyperLogLogPlusPlus", "Grouping", "GroupingID", "BitwiseAnd", "ShiftRight",
    "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "RowFrame", "RangeFrame", "CurrentRow", "UnboundedPreceding", "UnboundedFollowing", "RowNumber", "Rank", "DenseRank", "PercentRank", "CumeDist", "NTile", "Lag", "Lead", "NthValue",
}


class Refused(ValueError):
    """A query that is not run, and why."""


def _each(seq) -> Iterator:
    return (seq.apply(k) for k in range(seq.size()))


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class Guard:
    """Judges queries over some named frames, which are registered as views of their names."""

    def __init__(self, spark: SparkSession, own: Mapping[str, DataFrame]):
        self.spark, self.own = spark, {}
        self.frames = dict(own)
        for name, df in own.items():
            df.createOrReplaceTempView(name)
            self.own[name] = spark.table(name)._jdf.queryExecution().analyzed()

    def read(self, query: str) -> DataFrame:
        """The query's frame, which has run nothing yet; raises Refused."""
        write, call = self.spark.range(1).select(T.is_write(F.lit(query)), T.is_call(F.lit(query))).first()
        if write or call:
            raise Refused("only read queries are allowed")
        self.spark._jsparkSession.sessionState().sqlParser().parseQuery(query)  # no command parses as a query
        for name, df in self.frames.items():
            df.createOrReplaceTempView(name)  # another guard of the session may have put its own there
        found = self.spark.sql(query)
        self._plan(found._jdf.queryExecution().analyzed())
        return found

    def _plan(self, node) -> None:
        kind = _name(node)
        if kind == "SubqueryAlias" and _name(node.child()) == "View" and any(node.sameResult(plan) for plan in self.own.values()):
            return
        children = list(_each(node.children()))
        if kind not in OPERATORS and not (not children and kind in EMPTY_LEAVES):
            raise Refused(f"only {', '.join(sorted(self.own))} can be read, with plain operators ({kind} is none)")
        for e in _each(node.expressions()):
            self._expression(e)
        for child in children:
            self._plan(child)
        if kind == "WithCTE":
            for made in _each(node.cteDefs()):
                self._plan(made)

    def _expression(self, e) -> None:
        kind = _name(e)
        if kind not in EXPRESSIONS:
            raise Refused(f"{e.prettyName()} is not allowed")
        if kind in ("ScalarSubquery", "Exists", "ListQuery"):
            self._plan(e.plan())
        for x in _each(e.children()):  # of a function that Spark rewrites, what it is rewritten to
            self._expression(x)
