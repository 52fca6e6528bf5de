"""A checker of formulas: what a compiler would stop at, found from the formula itself, and repairs driven by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formula as M
from . import text as X

#: Commands and environments that are defined without further packages than those of mathematics.
LETTERS = (
    "alpha", "beta", "gamma", "delta", "epsilon", "varepsilon", "zeta", "eta", "theta", "vartheta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi",
    "varpi", "rho", "varrho", "sigma", "varsigma", "tau", "upsilon", "phi", "varphi", "chi", "psi", "omega", "Gamma", "Delta", "Theta", "Lambda", "Xi",
    "Pi", "Sigma", "Upsilon", "Phi", "Psi", "Omega", "ell", "hbar", "partial", "nabla", "infty",
)
SIGNS = (
    "times", "cdot", "pm", "mp", "div", "le", "leq", "ge", "geq", "ne", "neq", "approx", "equiv", "sim", "propto", "in", "notin", "subset", "cup", "cap",
    "to", "rightarrow", "leftarrow", "Rightarrow", "mapsto", "forall", "exists", "ldots", "cdots", "quad", "qquad", "otimes", "oplus", "mid", "prime",
)
FORMS = (
    "frac", "dfrac", "tfrac", "sqrt", "sum", "prod", "int", "iint", "oint", "lim", "log", "ln", "exp", "sin", "cos", "tan", "min", "max", "left", "right",
    "text", "mathrm", "mathbf", "mathcal", "mathsf", "mathbb", "boldsymbol", "operatorname", "hat", "bar", "tilde", "vec", "dot", "overline", "underline",
)
ENVIRONMENTS = ("matrix", "pmatrix", "bmatrix", "vmatrix", "cases", "aligned", "gathered", "split", "array")

TOKEN = r"\\(?:begin|end)\{[A-Za-z*]*\}|\\[A-Za-z]+|\\.|[{}]"
_STATE = "struct<open:array<string>,kind:string,name:string>"


def fault(formula: Column, commands: Column | None = None) -> Column:
    """The first thing a compiler would stop at, as struct (kind, name); both null for a formula that passes or is null.

    Tokens are read once, from the left, with a stack of what is open. Kinds: ``undefined`` (a command that is not in
    ``commands``, by default those above), ``environment`` (an unknown one begins), ``mismatch`` (an end or a brace that
    closes something else than what is open last, or nothing), ``unclosed`` (the innermost that is open at the end).
    """
    known = F.array(*map(F.lit, LETTERS + SIGNS + FORMS)) if commands is None else commands
    environments = F.array(*map(F.lit, ENVIRONMENTS))
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("open"), none.alias("kind"), none.alias("name"))

    def step(a: Column, token: Column) -> Column:
        state = lambda held, kind, name: F.struct(held.alias("open"), kind.alias("kind"), name.alias("name"))
        stop = lambda kind, name: state(a["open"], F.lit(kind), name)
        push = lambda name: state(F.concat(a["open"], F.array(name)), none, none)
        pop = state(F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1), none, none)
        last = F.coalesce(F.try_element_at(a["open"], F.lit(-1)), F.lit(""))
        word = F.regexp_extract(token, r"^\\([A-Za-z]+)$", 1)
        name = F.regexp_extract(token, r"\{([A-Za-z*]*)\}", 1)
        return (
            F.when(a["kind"].isNotNull(), a)
            .when(token == "{", push(F.lit("{")))
            .when(token == "}", F.when(last == "{", pop).otherwise(stop("mismatch", F.lit("}"))))
            .when(token.startswith("\\begin{"), F.when(F.array_contains(environments, name), push(name)).otherwise(stop("environment", name)))
            .when(token.startswith("\\end{"), F.when((last == name) & (name != ""), pop).otherwise(stop("mismatch", name)))
            .when((word == "") | F.array_contains(known, word), a)
            .otherwise(stop("undefined", word))
        )

    def finish(a: Column) -> Column:
        rest = a["kind"].isNull() & (F.size(a["open"]) > 0)
        return F.struct(F.when(rest, "unclosed").otherwise(a["kind"]).alias("kind"), F.when(rest, F.element_at(a["open"], -1)).otherwise(a["name"]).alias("name"))

    tokens = F.coalesce(F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    return F.aggregate(tokens, start.cast(_STATE), lambda a, t: step(a, t).cast(_STATE), finish)


def repaired_by_check(formula: Column, budget: int = 2, commands: Column | None = None) -> Column:
    """Check and repair: struct (formula, repairs, kind, name).

    Each formula has a budget of its own: checked, and where the fault is an undefined command that a rule can repair, set
    anew and checked again. kind and name are the fault that is left (null: it passes), repairs the rounds that changed it.
    """

    def checked(f: Column, n: Column) -> Column:
        return X.let(f, lambda x: F.struct(x.alias("formula"), n.cast("int").alias("repairs"), fault(x, commands).alias("fault")))

    def step(a: Column, _: Column) -> Column:
        better = F.when(a["fault"]["kind"] == "undefined", M.repaired(a["formula"], a["fault"]["name"]))
        return X.let(better, lambda b: F.when(b.isNull(), a).otherwise(checked(b, a["repairs"] + 1)))

    flat = lambda a: F.struct(a["formula"], a["repairs"], a["fault"]["kind"].alias("kind"), a["fault"]["name"].alias("name"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(budget)), checked(formula, F.lit(0)), step, flat)
