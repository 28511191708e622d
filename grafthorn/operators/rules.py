"""Rules to a fixed point, with the rule and pass that made each triple.

``infer`` runs each stratum: rules that run once, then the others semi-naively. A first pass reads all
triples; later ones have a variant of a rule for each pattern that reads only the last pass's new triples. All
rules of a pass are one Spark job; new triples are grouped to their first rule, anti-joined with what is known of the predicates that they can
have, and written to the shared folder as tables bucketed by (s, o), so that a pass deals out what it made and not what is known. A recursive stratum's part
of the base is laid out in the same way once. Every few passes the tables written so far become one.

A recursive stratum whose rules only compare terms (patterns and NOT of patterns) runs on 64-bit numbers of terms: no pass shuffles or compares
a text. What it made is printed once, when it is done.

A rule that fails, when its plan is built or in a job, is reported and the others go on. Rules that can't be put in strata
are reported too, and then the facts are all that comes out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafthorn.operators.patterns import Not, Path, column, expanded, instances, is_variable, solutions, variables
from grafthorn.plans.strata import NotStratifiable, patterns_in, runs_once, strata
from grafthorn.sources import numbers
from grafthorn.sources.graph import Graph, as_graph, plain_triples
from grafthorn.sources.shared import bucketed, written

MAX_PASSES = 100
#: Tables of passes that become one.
COMPACT_AFTER = 6


@dataclass(frozen=True)
class Rule:
    """Head patterns made for each solution of the body.

    ``focus`` (a variable and a table of nodes, made from the triples known) limits it to those nodes. ``focus_reads`` are the predicates
    on which that table depends (None: any); where no rule of a stratum makes one of them, it is made once.
    """

    head: Sequence[tuple]
    body: Sequence
    name: str | None = None
    focus: tuple[str, Callable[[DataFrame], DataFrame]] | None = field(default=None, compare=False)
    focus_reads: frozenset[str] | None = field(default=None, compare=False)

    def label(self, number: int) -> str:
        """Its name, else one by its number; a rule with a focus has its number among those."""
        if self.name:
            return self.name
        if self.focus:
            return f"Targeted rule {number + 1} (FOR ?{self.focus[0].lstrip('?')})"
        p = next((h[1] for h in self.head if isinstance(h[1], str) and h[1].startswith("<")), None)
        local = p.strip("<>").replace("#", "/").rpartition("/")[2] if p else ""
        return f"Rule {number + 1}: {local}" if local else f"Rule {number + 1}"


@dataclass(frozen=True)
class Run:
    """What a run gives: new triples (s, p, o, rule_index, rule_name, iteration), the rules' names, all passes, and what failed."""

    triples: DataFrame
    rules: list[str]
    iterations: int
    errors: list[str]


def labels(rules: Sequence[Rule]) -> list[str]:
    """Each rule's name; rules with a focus are numbered among themselves."""
    focused = itertools.count()
    return [r.label(next(focused) if r.focus else n) for n, r in enumerate(rules)]


def transitive(p: str) -> list[Rule]:
    return [Rule([("?x", p, "?z")], [("?x", p, "?y"), ("?y", p, "?z")])]


def symmetric(p: str) -> list[Rule]:
    return [Rule([("?b", p, "?a")], [("?a", p, "?b")])]


def inverse(p: str, q: str) -> list[Rule]:
    return [Rule([("?b", q, "?a")], [("?a", p, "?b")]), Rule([("?b", p, "?a")], [("?a", q, "?b")])]


def problems(rule: Rule) -> list[str]:
    """Why a rule isn't well-formed: variables read before they are bound, bound twice, or unbound in the head."""
    found: list[str] = []

    def read(body: Sequence, bound: set[str]) -> set[str]:
        for e in body:
            if isinstance(e, Not):
                read(e.body, set(bound))
                continue
            if not isinstance(e, tuple):
                found.extend(f"{x} is read before it is bound" for x in e.reads if x not in bound)
                if hasattr(e, "name"):
                    if e.name in bound:
                        found.append(f"{e.name} is assigned but already bound")
                    bound.add(e.name)
            else:
                bound |= set(variables([e]))
        return bound

    bound = read(rule.body, {rule.focus[0]} if rule.focus else set())
    found += [f"{x} in the head is not bound by the body" for h in rule.head for x in h if is_variable(x) and x not in bound]
    return found


def data(spark, triples: Sequence[tuple[str, str, str]]) -> Graph:
    """Ground triples as a graph."""
    if any(is_variable(x) for t in triples for x in t):
        raise ValueError("data triples must be ground")
    return Graph((), [(spark.createDataFrame(list(triples), "s string, p string, o string"), frozenset(p for _, p, _ in triples))])


def _heads(rules: Sequence[Rule]) -> list[str] | None:
    """The predicates of what rules make; None if a head's predicate is a variable."""
    found = [h[1] for r in rules for h in r.head if not isinstance(h[1], Path)]
    return None if any(is_variable(p) for p in found) else sorted(set(found))


def _touched(rules: Sequence[Rule]) -> list[str] | None:
    """All predicates that rules read or make; None if one is a variable."""
    found = {p[1] for r in rules for p, _ in patterns_in(r.body)} | {h[1] for r in rules for h in r.head if not isinstance(h[1], Path)}
    return None if any(is_variable(p) for p in found) else sorted(found)


def _compares_only(body: Sequence) -> bool:
    """Does a body hold nothing but patterns and NOT of such?"""
    return all(isinstance(e, tuple) or isinstance(e, Not) and _compares_only(e.body) for e in body)


def _constants(rules: Sequence[Rule]) -> set[str]:
    """Subjects, objects and predicates that heads name."""
    return {x for r in rules for h in r.head if not isinstance(h[1], Path) for x in h if not is_variable(x)}


def head_variables(rule: Rule) -> list[str]:
    return [x for h in rule.head for x in h if is_variable(x)]


def _variants(rule: Rule, everything: Graph, delta: DataFrame | None, delta_predicates: set[str] | None, focus: tuple[DataFrame, DataFrame | None] | None = None) -> list[DataFrame]:
    """The rule's solutions over all triples, or one table for each pattern that reads the delta.

    ``focus`` are the nodes of a rule with a focus, and those of them that are new since the last pass (None: none).
    """
    wanted = head_variables(rule)
    named = lambda df: df.select(F.col("node").alias(column(rule.focus[0])))
    seed = named(focus[0]) if focus else None
    if delta is None:
        return [solutions(everything, rule.body, seed, None, wanted)]
    plain = [p for e in rule.body if isinstance(e, tuple) for p in expanded(e)]
    reads = [n for n, p in enumerate(plain) if is_variable(p[1]) or delta_predicates is None or p[1] in delta_predicates]
    out = [solutions(everything, rule.body, seed, {n: delta}, wanted) for n in reads]
    return out + ([solutions(everything, rule.body, named(focus[1]), None, wanted)] if focus and focus[1] is not None else [])


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def fired(numbered: list[tuple[int, Rule]], everything: Graph, delta: DataFrame | None, delta_predicates: set[str] | None, focuses: dict[int, tuple[DataFrame, DataFrame | None]] | None = None) -> DataFrame | None:
    """(s, p, o, rule_index) of all rules; the first rule owns a triple that several make."""
    everything = as_graph(everything)
    tokens = any(numbers.is_numbered(df) for df, _ in everything.plain)
    parts = [instances(v, r.head, tokens).withColumn("rule_index", F.lit(n)) for n, r in numbered for v in _variants(r, everything, delta, delta_predicates, (focuses or {}).get(n))]
    return _united(parts).groupBy("s", "p", "o").agg(F.min("rule_index").alias("rule_index")) if parts else None


def unseen(made: DataFrame, known: Sequence[DataFrame]) -> DataFrame:
    """The triples made that no known table holds. Tables bucketed by (s, o) stay where they are; what was made is dealt out once for all of them.

    The predicate is no key of the join, since where all heads have the same one it wouldn't be a key of the other side either.
    """
    for table in known:
        k = table.select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
        made = made.join(k, (F.col("s") == F.col("_s")) & (F.col("o") == F.col("_o")) & (F.col("p") >= F.col("_p")) & (F.col("p") <= F.col("_p")), "left_anti")
    return made


def facts_predicates(facts: DataFrame | Graph) -> frozenset[str] | None:
    """The predicates that facts may have; None if any."""
    holds = [h for _, h in facts.plain] + [frozenset(m.predicates()) for m in facts.maps] if isinstance(facts, Graph) else [None]
    return None if None in holds else frozenset().union(*holds)


def _reason(e: Exception) -> str:
    """The first line of an error, without Spark's state code."""
    return (str(e).splitlines() or [""])[0].partition(" SQLSTATE: ")[0] or type(e).__name__


def run(base: DataFrame, rules: Sequence[Rule], facts: DataFrame | None = None, max_passes: int = MAX_PASSES, gates: dict[tuple[int, int], bool] | None = None) -> Run:
    """New triples of the rules over ``base`` and ``facts``, with errors kept apart.

    Facts that the base lacks come out with iteration 0 and rule name ``DATA block``. A stratum stops after ``max_passes`` passes (0 is the
    usual number). Passes are counted over the strata: one of each for its rules that run once, and one for each pass of the others with the
    last, which finds nothing. A pass reads what the passes before it made.
    """
    schema = "s string, p string, o string, rule_index int, rule_name string, iteration int"
    start = as_graph(base)
    produced: list[DataFrame] = []
    made_so_far: list[tuple[DataFrame, list[str] | None]] = []
    errors: list[str] = []
    names, iteration = labels(rules), 0
    if facts is not None:
        fresh = facts.select("s", "p", "o").distinct().join(start.triples(), ["s", "p", "o"], "left_anti")
        produced.append(fresh.select("s", "p", "o", F.lit(-1).alias("rule_index"), F.lit("DATA block").alias("rule_name"), F.lit(0).alias("iteration")))
        start = start.with_triples(fresh, sorted(holds) if (holds := facts_predicates(facts)) is not None else None)
    try:
        layers = strata(rules, gates) if rules else []
    except NotStratifiable as e:
        layers = []
        errors.append(f"Stratification failed: {e}")
    name_of = F.create_map(*[F.lit(x) for n, name in enumerate(names) for x in (n, name)]) if rules else None

    def named(new: DataFrame) -> DataFrame:
        return new.select("s", "p", "o", "rule_index", name_of[F.col("rule_index")].alias("rule_name"), "iteration")

    def known() -> Graph:
        out = start if laid is None else Graph((), [(laid[0], laid[1])])
        for df, holds in made_so_far:
            out = out.with_triples(df, holds)
        return out

    def fresh_of(numbered: list[tuple[int, Rule]], delta: DataFrame | None, predicates: set[str] | None) -> DataFrame | None:
        everything = known()
        made = fired(numbered, everything, delta, predicates, {n: focus_of(n, r, everything, delta) for n, r in numbered if r.focus})
        if made is None:
            return None
        # Only tables that may hold what these rules make have to be looked at.
        heads = _heads([r for _, r in numbered])
        before = start.of_predicates(heads) if laid is None else laid[0]
        tables = [] if before is None else [before]
        tables += [df for df, holds in made_so_far if heads is None or holds is None or set(heads) & set(holds)]
        return bucketed(unseen(made, tables), "s", "o")

    def focus_of(n: int, rule: Rule, everything: Graph, delta: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """A rule's nodes in this pass, and the new ones; made again only where the stratum makes what they depend on."""
        old = focuses.get(n)
        if delta is not None and old is not None and rule.focus_reads is not None and stratum_heads is not None and not rule.focus_reads & set(stratum_heads):
            return old, None
        now = focuses[n] = written(rule.focus[1](everything).select("node"))
        return now, now.join(old, "node", "left_anti") if old is not None else None

    def emit(numbered: list[tuple[int, Rule]], delta: DataFrame | None, predicates: set[str] | None) -> DataFrame | None:
        """One pass of rules that haven't failed; where it fails, each by itself, so that the others go on."""
        own = [(n, r) for n, r in numbered if n not in failed]
        try:
            new = fresh_of(own, delta, predicates)
        except Exception:  # noqa: BLE001 - whatever a rule raises is its error
            good = []
            for n, r in own:
                try:
                    good.append(fresh_of([(n, r)], delta, predicates))
                except Exception as e:  # noqa: BLE001
                    failed.add(n)
                    errors.append(f'Error evaluating rule "{names[n]}": {_reason(e)}')
            good = [g for g in good if g is not None]
            new = bucketed(_united(good).groupBy("s", "p", "o").agg(F.min("rule_index").alias("rule_index")), "s", "o") if good else None
        if new is None or new.isEmpty():
            return None
        (produced if book is None else numbered_passes).append(named(new.withColumn("iteration", F.lit(iteration))))
        made_so_far.append((new.select("s", "p", "o"), _heads([r for _, r in own])))
        if len(made_so_far) == COMPACT_AFTER:
            holds = [h for _, h in made_so_far]
            made_so_far[:] = [(bucketed(_united([df for df, _ in made_so_far]), "s", "o"), None if None in holds else sorted({p for h in holds for p in h}))]
        return new

    failed: set[int] = set()
    laid: tuple[DataFrame, frozenset[str]] | None = None
    book: DataFrame | None = None
    numbered_passes: list[DataFrame] = []
    focuses: dict[int, DataFrame] = {}
    stratum_heads: list[str] | None = None
    for layer in layers:
        stratum_heads, laid = _heads([rules[n] for n in layer]), None
        focuses.clear()
        once = [(n, rules[n]) for n in layer if runs_once(rules[n])]
        general = [(n, rules[n]) for n in layer if not runs_once(rules[n])]
        iteration += 1
        if once:
            emit(once, None, None)
        recursive = any(any(p[1] == h[1] or is_variable(p[1]) or is_variable(h[1]) for p, _ in patterns_in(r.body) for _, q in general for h in q.head) for _, r in general)
        # Nodes of a focus may grow by what this stratum makes.
        recursive = recursive or any(r.focus and (r.focus_reads is None or stratum_heads is None or r.focus_reads & set(stratum_heads)) for _, r in general)
        delta, predicates = None, None
        touched = _touched([r for _, r in general])
        if recursive and touched is not None and not any(r.focus for _, r in general):
            # What the passes read and compare is printed and dealt out once, not in each of them.
            bare = [r for _, r in general]
            whole = known().of_predicates(touched) if all(_compares_only(r.body) for r in bare) else None
            book = numbers.dictionary(whole, _constants(bare) | set(touched)) if whole is not None else None
            if book is not None:
                laid = (bucketed(numbers.numbered(whole).distinct(), "s", "o"), frozenset(touched))
                earlier, made_so_far[:] = list(made_so_far), []
            else:
                own = start.of_predicates(touched)
                laid = (bucketed(own.distinct(), "s", "o"), frozenset(touched)) if own is not None else None
        for _ in range((max_passes or MAX_PASSES) if general else 0):
            iteration += 1
            new = emit(general, delta, predicates)
            if new is None:
                break
            if not recursive:
                # The next pass would find nothing; it counts where it may be made.
                iteration += (max_passes or MAX_PASSES) > 1
                break
            delta = new.select("s", "p", "o")
            predicates = {h[1] for _, r in general for h in r.head}
            predicates = None if any(is_variable(p) for p in predicates) else predicates
        if book is not None:
            found = numbers.printed(_united(numbered_passes), book, touched) if numbered_passes else None
            if found is not None and layer is not layers[-1]:
                found = bucketed(found, "s", "o")
            produced += [found] if found is not None else []
            made_so_far[:] = earlier + ([(found.select("s", "p", "o"), stratum_heads)] if found is not None else [])
            book = None
            numbered_passes.clear()
    triples = _united(produced) if produced else base.sparkSession.createDataFrame([], schema)
    return Run(triples, names, iteration, errors)


def infer(base: DataFrame, rules: Sequence[Rule], facts: DataFrame | None = None, max_passes: int = MAX_PASSES, gates: dict[tuple[int, int], bool] | None = None) -> DataFrame:
    """The triples of ``run``; raises if a rule failed or the rules can't be put in strata."""
    if rules:
        strata(rules, gates)
    done = run(base, rules, facts, max_passes, gates)
    if done.errors:
        raise RuntimeError("; ".join(done.errors))
    return done.triples


def output_graph(base: DataFrame, inferred: DataFrame) -> DataFrame:
    """Base and inferred triples together."""
    return plain_triples(base).select("s", "p", "o").unionByName(inferred.select("s", "p", "o"))
