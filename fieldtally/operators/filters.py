"""The safe filter language: a text condition becomes one Spark ``Column``.

Python's own ``ast`` reads the text. What is accepted: comparisons (chained too), ``and or not & | ~``,
``in``/``not in`` lists or columns, ``+ - * / %``, ``.isna() .notna() .isin([..])`` and
``.str.contains/startswith/endswith(..)``. Everything else is refused before any job starts.

A condition on a missing value is false, except ``!=`` and ``not in``, which are its negation and so true.
Plain comparisons stay plain (a NULL drops the row anyway) and therefore reach the Parquet reader; they are
settled to false only where they are negated, compared or counted. Which comparisons make sense is decided
from the schema, so a run never meets a cast error whose text could quote a cell.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.errors import NotComputable
from fieldtally.functions.columns import col, families
from fieldtally.functions.numbers import floored_modulo, quotient

ALLOWED = (
    "it knows comparisons such as \"region == 'North'\", and/or/not, in [..], + - * / %, "
    ".isna(), .notna(), .isin([..]) and .str.contains/startswith/endswith(..)"
)
NEXT_STEP = "take another column, or rename it in the clean copy if it holds nothing personal"
SEE_COLUMNS = "`profile` lists the columns and their types"

NUMERIC = ("whole", "real", "bool")
ORDERINGS = {
    ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
}
STEPS = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}
TEXT_METHODS = {"contains": ("pat", "case", "flags", "na", "regex"), "startswith": ("pat", "na"), "endswith": ("pat", "na")}
OPTIONS = ("case", "na", "regex")  # those that may be given by name
META = frozenset(".^$*+?{}[]\\|()")


class _NotAllowed(Exception):
    """Syntax outside the language."""


class _Unsuitable(Exception):
    """Accepted syntax that does not fit the column types."""


class _Unknown(Exception):
    """A name that is no column."""


class _Personal(Exception):
    """A column of personal data."""


@dataclass(frozen=True)
class Value:
    """A typed operand. ``const`` holds the Python value of a literal, ``items`` those of a list.

    ``condition`` marks a comparison result, where NULL stands for false.
    """

    kind: str
    column: Column | None = None
    const: object = None
    items: tuple | None = None
    condition: bool = False

    @property
    def literal(self) -> bool:
        return self.column is None

    @property
    def expr(self) -> Column:
        if self.column is None:
            return F.lit(float(self.const) if self.kind == "real" else self.const)
        return _settled(self.column) if self.condition else self.column


@dataclass(frozen=True)
class Membership:
    """``left in right`` for two columns: is the value anywhere in the other column?"""

    marker: str
    left: Column
    right: Column
    within: tuple[Column, ...]


@dataclass
class Compiler:
    """Compiles one condition; ``within`` limits column membership to the same group."""

    kinds: dict[str, str]
    quoted: dict[str, str]
    within: tuple[Column, ...] = ()
    prefix: str = "__in"
    memberships: list[Membership] = field(default_factory=list)
    personal: frozenset[str] | set[str] = frozenset()
    spark: SparkSession | None = None

    def condition(self, node: ast.AST) -> Value:
        """What decides about a row: a comparison, a test of a column, or several joined; nothing else does."""
        match node:
            case ast.BoolOp(op=op, values=values):
                return reduce(lambda a, b: _both(op, a, b), map(self.condition, values))
            case ast.UnaryOp(op=ast.Invert() | ast.Not(), operand=inner):
                return Value("bool", ~_settled(self.condition(inner).column), condition=True)
            case ast.Compare() | ast.Call():
                return self.operand(node)
        raise _NotAllowed("a row is chosen by a comparison or a test")

    # -- operands ---------------------------------------------------------------------
    def constant(self, node: ast.AST) -> object:
        """The value of a literal, which may carry a sign."""
        match node:
            case ast.Constant(value=None | str() | int() | float() as const):
                return const
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() as sign, operand=ast.Constant(value=int() | float() as number)):
                if not isinstance(number, bool):
                    return -number if isinstance(sign, ast.USub) else number
        raise _NotAllowed("a literal is expected")

    def items(self, node: ast.AST) -> tuple:
        if not isinstance(node, (ast.List, ast.Tuple)):
            raise _NotAllowed("a list of literals is expected")
        return tuple(map(self.constant, node.elts))

    def operand(self, node: ast.AST) -> Value:
        match node:
            case ast.Name(id=name):
                return self.named(name)
            case ast.Constant() | ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=ast.Constant()):
                const = self.constant(node)
                return Value(_kind_of(const), const=const)
            case ast.List() | ast.Tuple():
                return Value("list", items=self.items(node))
            case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=inner):
                value = _numeric(self.operand(inner))
                if isinstance(node.op, ast.UAdd):
                    return value
                return _arithmetic(ast.Sub(), Value("whole", const=0), value)
            case ast.UnaryOp(op=ast.Invert() | ast.Not(), operand=inner):
                value = self.operand(inner)
                if value.kind == "bool" and value.column is not None:
                    return Value("bool", ~_settled(value.column), condition=True)
                if value.kind == "whole" and value.column is not None:
                    return Value("whole", F.bitwise_not(value.column))
                raise _Unsuitable
            case ast.BinOp(left=left, op=op, right=right):
                return _arithmetic(op, self.operand(left), self.operand(right))
            case ast.BoolOp(op=op, values=values):
                return reduce(lambda a, b: _both(op, a, b), map(self.operand, values))
            case ast.Compare(left=left, ops=ops, comparators=rest):
                sides = [self.operand(n) for n in (left, *rest)]
                pairs = [self.pair(op, a, b) for op, a, b in zip(ops, sides, sides[1:])]
                return Value("bool", reduce(operator.and_, pairs), condition=True)
            case ast.Call():
                return Value("bool", self.call(node), condition=True)
        raise _NotAllowed

    def named(self, name: str) -> Value:
        column = self.quoted.get(name, name)
        if column in self.personal:  # reached by a spelling that the parser folds
            raise _Personal(column)
        if column not in self.kinds:
            raise _Unknown(column)
        kind, value = self.kinds[column], col(column)
        if kind == "whole":
            value = value.cast("bigint")
        elif kind == "real":
            value = value.cast("double")
        elif kind == "time":
            value = value.cast("timestamp_ntz")
        return Value(kind, value)

    # -- comparisons ------------------------------------------------------------------
    def pair(self, op: ast.cmpop, a: Value, b: Value) -> Column:
        if a.literal and b.literal:
            raise _Unsuitable
        match op:
            case ast.Eq():
                return self.equal(a, b)
            case ast.NotEq():
                return self.unequal(a, b)
            case ast.In():
                return self.member(a, b)
            case ast.NotIn():
                return ~_settled(self.member(a, b))
        if type(op) not in ORDERINGS:
            raise _NotAllowed("is and is not compare objects, not values")
        return _ordered(ORDERINGS[type(op)], a, b)

    def equal(self, a: Value, b: Value) -> Column:
        if a.kind == "list" or b.kind == "list":
            column, values = (b, a) if a.kind == "list" else (a, b)
            return _in_list(column, values.items)
        if a.literal:
            a, b = b, a
        if b.kind == "none":
            return F.lit(False)
        sides = _alike(a, b)
        return sides[0] == sides[1] if sides else F.lit(False)

    def unequal(self, a: Value, b: Value) -> Column:
        sides = None if "list" in (a.kind, b.kind) or "none" in (a.kind, b.kind) else _alike(a, b)
        if sides and (a.literal or b.literal):
            return ~sides[0].eqNullSafe(sides[1])
        return ~_settled(self.equal(a, b))

    def member(self, a: Value, b: Value) -> Column:
        if b.kind == "list":
            return _in_list(a, b.items)
        if a.kind == "list" or (a.literal and a.kind == "text"):
            return _in_list(b, a.items if a.kind == "list" else (a.const,))
        if b.literal and b.kind == "text":
            return _in_list(a, (b.const,))
        if a.literal or b.literal:
            raise _Unsuitable
        sides = _alike(a, b)
        if sides is None:
            sides = (F.when(a.column.isNull(), F.lit(None).cast("string")).otherwise(F.lit("a")),
                     F.when(b.column.isNull(), F.lit(None).cast("string")).otherwise(F.lit("b")))
        marker = f"{self.prefix}_{len(self.memberships)}"
        self.memberships.append(Membership(marker, sides[0], sides[1], self.within))
        return col(marker)

    # -- column methods ---------------------------------------------------------------
    def call(self, node: ast.Call) -> Column:
        options = {given.arg: self.constant(given.value) for given in node.keywords}
        if not set(options) <= set(OPTIONS):
            raise _NotAllowed("an unknown option")
        match node.func:
            case ast.Attribute(value=ast.Attribute(value=ast.Name() as name, attr="str"), attr=method) if method in TEXT_METHODS:
                args = list(map(self.constant, node.args))
                return self.text_test(method, self.operand(name), args, options)
            case ast.Attribute(value=ast.Name() as name, attr="isna" | "notna" as method) if not node.args:
                value = self.operand(name).column
                test = value.isNull() if method == "isna" else value.isNotNull()
            case ast.Attribute(value=ast.Name() as name, attr="isin") if len(node.args) == 1:
                test = _in_list(self.operand(name), self.items(node.args[0]))
            case _:
                raise _NotAllowed("an unknown test")
        if options:
            raise _Unsuitable
        return test

    def text_test(self, method: str, value: Value, args: list, options: dict) -> Column:
        names = TEXT_METHODS[method]
        if len(args) > len(names) or not set(options) <= set(names[len(args) :]):
            raise _Unsuitable
        given = {**dict(zip(names, args)), **options}
        pattern, na = given.get("pat"), given.get("na")
        if value.kind != "text" or not isinstance(pattern, str) or not isinstance(na, (bool, type(None))):
            raise _Unsuitable
        case, regex, flags = given.get("case", True), given.get("regex", True), given.get("flags", 0)
        if method == "startswith":
            hit = F.startswith(value.column, F.lit(pattern))
        elif method == "endswith":
            hit = F.endswith(value.column, F.lit(pattern))
        elif regex:
            hit = value.column.rlike(self.checked(java_regex(pattern, bool(case), flags), pattern))
        elif case:
            hit = F.contains(value.column, F.lit(pattern))
        else:
            hit = F.contains(F.upper(value.column), F.lit(pattern.upper()))
        return F.coalesce(hit, F.lit(True)) if na else hit

    def checked(self, java: str, pattern: str) -> str:
        """Let the JVM read a pattern once, on a literal (no job), so a bad one fails here and not in a task."""
        if self.spark is not None and META & set(pattern):
            try:
                self.spark.sql("SELECT rlike('', :pattern)", args={"pattern": java}).collect()
            except Exception:
                raise _Unsuitable from None
        return java


# -- helpers on typed operands ------------------------------------------------------------
def _kind_of(const: object) -> str:
    if const is None:
        return "none"
    if isinstance(const, bool):
        return "bool"
    if isinstance(const, int):
        return "whole" if -(2**63) <= const < 2**63 else "real"
    return "real" if isinstance(const, float) else "text"


def _settled(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _moment(text: str) -> Column | None:
    """A literal UTC moment, or None for text that is no ISO date."""
    try:
        moment = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _alike(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Both sides in one comparable type, or None when the kinds can never be equal."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        x, y = a.expr, b.expr
        if a.kind == b.kind:
            return x, y
        common = "double" if "real" in (a.kind, b.kind) else "bigint"
        return x.cast(common), y.cast(common)
    if a.kind == "time" and b.kind == "text" and b.literal:
        moment = _moment(b.const)
        return None if moment is None else (a.column, moment)
    if b.kind == "time" and a.kind == "text" and a.literal:
        moment = _moment(a.const)
        return None if moment is None else (moment, b.column)
    if a.kind == b.kind and a.kind in ("text", "time"):
        return a.expr, b.expr
    return None


def _ordered(compare: Callable, a: Value, b: Value) -> Column:
    sides = _alike(a, b)
    if sides is None:
        raise _Unsuitable
    return compare(*sides)


def _in_list(value: Value, items: Sequence) -> Column:
    """Membership in literals; items of another kind never match, None matches missing."""
    if value.column is None:
        raise _Unsuitable
    fitting: list[tuple[Column, Column]] = []
    numbers = [i for i in items if _kind_of(i) in NUMERIC]
    texts = [i for i in items if isinstance(i, str)]
    if value.kind in NUMERIC:
        # one common type for the whole list
        kinds = {_kind_of(i) for i in numbers}
        common = "real" if "real" in kinds | {value.kind} else "whole"
        as_common = float if common == "real" else int
        fitting = [_alike(value, Value(common, const=as_common(i))) for i in numbers]
    elif value.kind in ("text", "time"):
        fitting = [pair for i in texts if (pair := _alike(value, Value("text", const=i)))]
    tests = []
    if fitting:
        tests.append(fitting[0][0].isin([item for _, item in fitting]))
    if any(item is None for item in items):
        tests.append(value.column.isNull())
    return reduce(operator.or_, tests) if tests else F.lit(False)


def _numeric(value: Value) -> Value:
    if value.kind not in NUMERIC:
        raise _Unsuitable
    if value.kind == "bool":
        if value.column is None:
            return Value("whole", const=int(value.const))
        return Value("whole", value.expr.cast("bigint"))
    return value


def _arithmetic(op: ast.operator, a: Value, b: Value) -> Value:
    if not isinstance(op, (*STEPS, ast.Div, ast.Mod)):
        raise _NotAllowed("an unknown operator")
    if isinstance(op, ast.Add) and a.kind == b.kind == "text":
        return Value("text", F.concat(a.expr, b.expr))
    if a.literal and b.literal:
        raise _Unsuitable
    a, b = _numeric(a), _numeric(b)
    x, y = a.expr, b.expr
    if isinstance(op, ast.Div):
        return Value("real", quotient(x, y))
    whole = a.kind == b.kind == "whole"
    if not whole:
        x, y = x.cast("double"), y.cast("double")
    if isinstance(op, ast.Mod):
        result = floored_modulo(x, y)
    else:
        # try_*: an integer overflow becomes a missing value, never an error quoting cells
        result = STEPS[type(op)](x, y)
    return Value("whole", result) if whole else Value("real", F.nanvl(result, F.lit(None)))


def _both(op: ast.boolop, a: Value, b: Value) -> Value:
    if a.column is None or b.column is None:
        raise _Unsuitable
    conjunction = isinstance(op, ast.And)
    if a.kind == b.kind == "bool":
        x, y = a.column, b.column
        return Value("bool", x & y if conjunction else x | y, condition=True)
    if a.kind == b.kind == "whole":
        return Value(
            "whole", a.column.bitwiseAND(b.column) if conjunction else a.column.bitwiseOR(b.column)
        )
    raise _Unsuitable


# -- patterns -----------------------------------------------------------------------------
def java_regex(pattern: str, case: bool = True, flags: int = 0) -> str:
    """The same search for the JVM: Unicode classes, ``\\n`` as the only line end."""
    known = re.IGNORECASE | re.MULTILINE | re.DOTALL
    if not isinstance(flags, int) or isinstance(flags, bool) or flags & ~int(known):
        raise _Unsuitable
    try:
        re.compile(pattern, flags)
    except (re.error, OverflowError, RecursionError):
        raise _Unsuitable from None
    letters = "dU"
    if not case or flags & re.IGNORECASE:
        letters += "i"
    if flags & re.MULTILINE:
        letters += "m"
    if flags & re.DOTALL:
        letters += "s"
    # "[" inside a class, a leading "]" and "&&" are plain characters in Python, set syntax in Java
    body, escaped, inside, leading = [], False, False, False
    for here, nxt in zip(pattern, pattern[1:] + " "):
        if escaped:
            here, escaped, leading = ("z" if here == "Z" else here), False, False
        elif here == "\\":
            escaped = True
        elif not inside:
            inside = leading = here == "["
        elif here == "]" and not leading:
            inside = False
        else:
            if here in "[]" or (here == nxt == "&"):
                body.append("\\")
            leading = leading and here == "^" and body[-1] == "["
        body.append(here)
    java = "".join(body).replace("(?P<", "(?<")
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java)
    return f"(?{letters})" + java


# -- reading the text -----------------------------------------------------------------------
CONNECTIVES = {"&": " and ", "|": " or "}  # these signs bind like the words
NOT_IN_NAMES = frozenset("'\"\\#")


@dataclass(frozen=True)
class Condition:
    """A condition's syntax tree, and the column behind each name that stands for a back-ticked one."""

    tree: ast.expr
    quoted: dict[str, str]


def _end_of_literal(text: str, at: int) -> int:
    """Behind the closing quote of the literal that opens at ``at``."""
    quote = text[at] * 3 if text.startswith(text[at] * 3, at) else text[at]
    end = at + len(quote)
    while not text.startswith(quote, end):
        if end >= len(text):
            raise _NotAllowed("a text is not closed")
        end += 2 if text[end] == "\\" else 1
    return end + len(quote)


def _pieces(text: str) -> Iterator[tuple[str, str]]:
    """The text in one walk, as (kind, piece): ``literal``, ``column`` (back-ticked), ``word`` or ``sign``; a comment ends it."""
    at = 0
    while at < len(text) and text[at] != "#":
        here, end = text[at], at + 1
        if here in "'\"":
            kind, end = "literal", _end_of_literal(text, at)
        elif here == "`":
            kind, end = "column", text.find("`", end) + 1
            if end < at + 3 or NOT_IN_NAMES & set(text[at:end]):
                raise _NotAllowed("a back-tick does not enclose a column name")
        elif here.isalnum() or here == "_":
            kind = "word"
            while end < len(text) and (text[end].isalnum() or text[end] == "_"):
                end += 1
        else:
            kind = "sign"
        yield kind, text[at:end]
        at = end


def read_condition(text: str) -> Condition:
    """Parse one line; raises ``_NotAllowed`` for text that is no expression of the language's shape."""
    if len(text.splitlines()) > 1:
        raise _NotAllowed("it has more than one line")
    pieces = list(_pieces(text.strip()))
    kinds = [kind for kind, _ in pieces]
    if any({"column"} < {*pair} <= {"column", "word"} or pair == ("column", "column") for pair in zip(kinds, kinds[1:])):
        raise _NotAllowed("a back-tick does not enclose a column name")
    words = {piece for kind, piece in pieces if kind == "word"}
    free = (name for n in count() if (name := f"column{n}") not in words)
    quoted: dict[str, str] = {}
    source = []
    for kind, piece in pieces:
        if kind == "column":
            source.append(next(free))
            quoted[source[-1]] = piece[1:-1]
        else:
            source.append(CONNECTIVES.get(piece, piece) if kind == "sign" else piece)
    try:
        return Condition(ast.parse("".join(source).strip(), mode="eval").body, quoted)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        raise _NotAllowed("it is no complete expression") from None


def _mentions(text: str, column: str) -> bool:
    return re.search(rf"(?<!\w){re.escape(column)}(?!\w)", text) is not None


def compile_filter(
    df: DataFrame,
    text: object,
    pii: Sequence[str] = (),
    within: Sequence[Column] = (),
    prefix: str = "__in",
) -> tuple[Column, list[Membership]]:
    """The condition as a boolean Column (NULL stands for false), and the memberships it needs."""
    if text is None or text == "":
        return F.lit(True), []
    text, personal = str(text), {str(name) for name in pii}
    try:
        # a personal column is refused wherever its name stands, in a literal too
        for name in sorted(personal):
            if _mentions(text, name):
                raise _Personal(name)
        condition = read_condition(text)
        compiler = Compiler(
            families(df), condition.quoted, tuple(within), prefix, personal=personal, spark=df.sparkSession
        )
        return compiler.condition(condition.tree).column, compiler.memberships
    except _Personal as found:
        raise NotComputable(
            f"the condition {text!r} reads {found.args[0]!r}, a column of personal data, which no report may use; {NEXT_STEP}"
        ) from None
    except _Unknown as found:
        raise NotComputable(
            f"the condition {text!r} reads {found.args[0]!r}, but the dataset has no such column ({SEE_COLUMNS})"
        ) from None
    except (_NotAllowed, RecursionError) as found:
        why = f" ({found.args[0]})" if isinstance(found, _NotAllowed) and found.args else ""
        raise NotComputable(f"the condition {text!r} is outside the filter language{why}; {ALLOWED}") from None
    except _Unsuitable:
        raise NotComputable(
            f"the condition {text!r} does not fit the types of its columns ({SEE_COLUMNS}); .str is for text columns"
        ) from None


def with_memberships(df: DataFrame, needed: Sequence[Membership]) -> DataFrame:
    """Add one marker column per membership: an equi-join with the distinct values of the other side.

    The join is null-safe: a missing value is a member when the other column has a missing value.
    Its right side has each value once, so it never multiplies rows, and a hot value on the left is
    split by the adaptive skew join.
    """
    for need in needed:
        keys = [f"{need.marker}_{n}" for n in range(len(need.within) + 1)]
        right = df.select(
            *(c.alias(k) for c, k in zip((*need.within, need.right), keys, strict=True))
        ).distinct().withColumn(need.marker, F.lit(True))
        tests = [
            left.eqNullSafe(col(k)) for left, k in zip((*need.within, need.left), keys, strict=True)
        ]
        df = df.join(right, reduce(operator.and_, tests), "left").drop(*keys)
    return df


def safe_filter(df: DataFrame, text: object, pii: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` that meet the condition; ``NotComputable`` before any job otherwise."""
    condition, needed = compile_filter(df, text, pii)
    if not needed:
        return df.filter(condition)
    return with_memberships(df, needed).filter(condition).select(*map(col, df.columns))
