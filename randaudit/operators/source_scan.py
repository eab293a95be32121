"""Scan of contract text for weak entropy sources: positions, context, use, risk, statistics.

Contracts are rows (contract_id, ..., code). Scans are generators followed by projections, all in built-in expressions;
code never crosses a shuffle, only hits with at most 400 characters of context do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from randaudit.functions import lexicon as lx
from randaudit.functions.text_rules import risk_level

#: Dialect of the scans: Unicode word classes, and only a line feed ends a line.
UNIX = "(?Ud)"
UNIX_ANYCASE = "(?Udiu)"
UNIX_LINES = "(?Udm)"


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'


def literals(regex: str) -> list[str] | None:
    """The runs of plain characters that every match of a regex holds; None if it has alternatives outside of groups."""
    runs, run, i, depth = [], "", 0, 0
    while i < len(regex):
        c, step = regex[i], 1
        plain = None
        if c == "\\":
            step, plain = 2, None if regex[i + 1].isalnum() else regex[i + 1]
        elif c == "[":
            step = regex.index("]", i + 2) + 1 - i
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            return None
        elif c not in ".^$|?*+":
            plain = c
        optional = regex[i + step : i + step + 1] in ("?", "*")
        if plain is not None and not depth and not optional:
            run += plain
        else:
            runs, run = [*runs, run], ""
        i += step
    return [r for r in (*runs, run) if r]


def without_retries(regex: str) -> str:
    """An equal condition for regexes of several parts that follow each other on a line, as `a.*b.*c` does.

    If the first `b` after an `a` has no `c` behind it, no later one has: so the place of `b` need not be tried again.
    """
    first, *middle, last = regex.split(".*") if ".*" in regex else ("", regex)
    plain = all(p and literals(p) is not None and "".join(literals(p)) == p.replace("\\", "") for p in middle)
    return ".*".join([first + "".join(f"(?>.*?{p})" for p in middle), last]) if middle and plain else regex


def holds(text: Column, regex: str, flags: str = UNIX) -> Column:
    """text.rlike(regex), but only for texts that hold the characters which every match needs: most don't, and that is quick to see."""
    needed, quick = literals(regex), flags + without_retries(regex)
    if needed is None:
        parts = regex.split("|")
        if all(literals(p) == [p] for p in parts):
            return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])
    if not needed:
        return text.rlike(quick)
    return F.when(reduce(lambda a, b: a & b, [F.contains(text, F.lit(n)) for n in needed]), text.rlike(quick)).otherwise(False)


#: Numbers that are summed up one by one; the sums of such runs are summed up above them.
RUN = 256


def _running(numbers: str) -> str:
    """SQL for the sums before each number of an array. Appending copies an array, so it is done in runs: work is n * RUN, not n * n."""
    fold = "aggregate({of}, named_struct('sum', {start}, 'at', cast(array() as array<int>)), (a, x) -> named_struct('sum', a.sum + {size}, 'at', array_append(a.at, a.sum)), a -> a.at)"
    inner = fold.format(of="p", start="o", size="x")
    outer = fold.format(of="runs", start="0", size="aggregate(x, 0, (t, y) -> t + y)")
    return f"""transform(array({numbers}), v -> transform(array(transform(sequence(0, greatest(size(v) - 1, 0), {RUN}), o -> slice(v, o + 1, {RUN}))), runs ->
              flatten(zip_with({outer}, runs, (o, p) -> {inner})))[0])[0]"""


def matches_sql(code: str, regex: str, groups: tuple[int, ...] = (0,), lines: bool = False) -> str:
    """SQL for an array of (position, text, g1, g2, ..., line) of all matches of a regex: 0-based code points, in order; line is from 1, if asked for.

    Texts without a match are scanned once. Positions and lines are running sums over the pieces between matches.
    """
    r = _quoted(regex)
    none = "cast(array() as array<string>)"
    named = "".join(f", 'g{k}', s.g{k}[i]" for k in groups if k)
    group_columns = "".join(f", 'g{k}', if(size(m) = 0, {none}, regexp_extract_all({code}, {r}, {k}))" for k in groups if k)
    places = _running("zip_with(s.parts, s.m, (p, m) -> length(p) + length(m))")
    breaks = lambda x: f"length({x}) - length(replace({x}, '\n', ''))"
    above = _running(f"zip_with(s.parts, s.m, (p, m) -> {breaks('p')} + {breaks('m')})") if lines else "s.m"
    line = f", 'line', s.above[i] + {breaks('s.parts[i]')} + 1" if lines else ""
    return f"""transform(transform(transform(array(regexp_extract_all({code}, {r}, 0)), m ->
                named_struct('m', m, 'parts', if(size(m) = 0, {none}, slice(split({code}, {r}, -1), 1, size(m))){group_columns})), s -> named_struct('s', s, 'at', {places}, 'above', {above})), t ->
              transform(array(named_struct('m', t.s.m, 'parts', t.s.parts, 'above', t.above{''.join(f", 'g{k}', t.s.g{k}" for k in groups if k)})), s ->
              transform(t.at, (at, i) -> named_struct('position', at + length(s.parts[i]), 'text', s.m[i]{named}{line})))[0])[0]"""


def matches(code: str, regex: str, groups: tuple[int, ...] = (0,)) -> Column:
    """The array of matches_sql() as a column."""
    return F.expr(matches_sql(code, regex, groups))


def exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    """df with a row for each element of an array that is costly to make.

    explode() would be given a filter on the array's size, which makes the array once more; explode_outer() isn't.
    """
    return df.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def tokens(contracts: DataFrame, rows: list[tuple] = lx.LEXICON, code: str = "code") -> DataFrame:
    """contracts with pattern, source_type, base_risk, description, ord, position: a row for each token occurrence."""
    literal = F.array(
        *[
            F.struct(
                F.lit(k).alias("ord"), F.lit(p).alias("pattern"), F.lit(t).alias("source_type"), F.lit(risk).alias("base_risk"),
                F.lit(d).alias("description"), F.lit(UNIX + lx.token_regex(p)).alias("regex"),
            )
            for k, (p, t, risk, d) in enumerate(rows)
        ]
    )
    some = "|".join(lx.token_regex(p) for p, *_ in rows)
    each = contracts.where(F.col(code).rlike(UNIX + some)).withColumn("token", F.explode(literal))
    each = each.where(F.expr(f"instr({code}, token.pattern) > 0"))
    places = F.expr(
        f"""aggregate(split({code}, token.regex, -1), named_struct('off', 0, 'at', cast(array() as array<int>)),
              (a, p) -> named_struct('off', a.off + length(p) + length(token.pattern), 'at', array_append(a.at, a.off + length(p))), a -> a.at)"""
    )
    # The fold also places a match after the last piece, which is no match.
    found = exploded(each.withColumn("places", places), F.expr("slice(places, 1, size(places) - 1)"), "position")
    return found.select("*", "token.pattern", "token.source_type", "token.base_risk", "token.description", "token.ord").drop("token", "places")


def token_alternation(rows: list[tuple]) -> str:
    """One expression for all tokens, so that a text is read once. A place that can't begin a token fails on its first character."""
    patterns = [p for p, *_ in rows]
    for p in patterns:
        for q in patterns:
            if p != q and any(q.startswith(p[k:]) or p[k:].startswith(q) for k in range(len(p)) if k == 0 or not (p[k - 1].isalnum() and p[k].isalnum())):
                raise ValueError(f"tokens overlap: {p!r} and {q!r}")
    firsts = "".join(sorted({p[0] for p in patterns}))
    return rf"(?=[{firsts}])\b(?:" + "|".join(lx.token_regex(p).removeprefix(r"\b") for p in patterns) + ")"


#: Characters of the pieces that a text is cut into once, for contexts of up to a third of that, so that none is counted from the text's start.
PIECE = 1024


def _around(code: str, found: str, around: int, fields: str, piece: int = PIECE) -> str:
    """SQL for the elements f of an array of matches with their `fields` and context: the text up to `around` characters on either side."""
    low = f"greatest(f.position - {around}, 0)"
    near = f"""substring(concat(get(s.pieces, {low} div {piece}), coalesce(get(s.pieces, {low} div {piece} + 1), '')), {low} % {piece} + 1, f.position + length(f.text) + {around} - {low})"""
    # A text without a match isn't cut.
    pieces = f"if(size(found) = 0, cast(array() as array<string>), regexp_extract_all({code}, r'(?s).{{1,{piece}}}', 0))"
    return f"""transform(transform(array({found}), found -> named_struct('pieces', {pieces}, 'found', found)), s -> transform(s.found, f -> named_struct({fields}, 'context', {near})))[0]"""


def _about(rows: list[tuple], pattern: Column) -> Column:
    """The lexicon's struct (pattern, source_type, base_risk, description) of a token."""
    all_rows = [F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("source_type"), F.lit(risk).alias("base_risk"), F.lit(d).alias("description")) for p, t, risk, d in rows]
    return F.get(F.array(*all_rows), F.array_position(F.array(*[F.lit(p) for p, *_ in rows]), pattern).cast("int") - 1)


def token_contexts(contracts: DataFrame, rows: list[tuple] = lx.LEXICON, around: int = 200) -> DataFrame:
    """contracts without code, with pattern, source_type, base_risk, description, position, context for each token occurrence.

    Contexts are cut before the rows are multiplied: no row but the contract's own carries its code. around is under PIECE / 3.
    """
    found = F.expr(_around("code", matches_sql("code", UNIX + token_alternation(rows)), around, "'position', f.position, 'text', f.text"))
    others = [c for c in contracts.columns if c != "code"]
    each = exploded(contracts.select(*others, found.alias("_hits")), F.col("_hits"), "_hit").drop("_hits")
    return each.withColumn("_row", _about(rows, F.col("_hit.text"))).select(*others, "_row.*", "_hit.position", "_hit.context")


def context(code: str = "code", before: int = 200, after: int = 200) -> Column:
    """The text around a token at `position`."""
    start = F.greatest(F.col("position") - before, F.lit(0))
    end = F.col("position") + F.length("pattern") + after
    return F.substring(F.col(code), start + 1, end - start)


def scores(low: Column) -> dict[str, Column]:
    """How many expressions of each context match a lower-cased text; lower-cased themselves, they need no slow case folding."""
    return {name: reduce(lambda a, b: a + b, [holds(low, r.lower()).cast("int") for r in regexes]) for name, regexes in lx.CONTEXTS.items()}


def use_of(low: Column, pattern: Column, known: Column | None = None) -> Column:
    """How a token is used, told by its lower-cased context (X3), or by the counts `known` of its expressions where they aren't null.

    Most tokens need to know whether a context is there at all; only for the others are all expressions counted.
    """

    def rule(there, count):
        gambling, timing, randomness, access = (there(n) for n in lx.CONTEXTS)
        counts = {n: count(n) for n in lx.CONTEXTS}
        best = F.greatest(*counts.values())
        highest = F.coalesce(F.when(best == 0, "unknown"), *[F.when(c == best, F.lit(n)) for n, c in counts.items()])
        time = F.when(gambling, "gambling").when(timing, F.when(randomness, "randomness").otherwise("timing")).when(randomness, "randomness")
        sender = F.when(randomness | gambling, "randomness").when(access, "access_control").when(timing, "timing")
        return (
            F.when(pattern.isin("block.timestamp", "now"), time.when(access, "access_control").otherwise("unknown"))
            .when(pattern == "msg.sender", sender.otherwise("unknown"))
            .when(pattern.isin("block.difficulty", "blockhash", "block.prevrandao"), F.when(gambling | timing | randomness | access, "randomness").otherwise("unknown"))
            .otherwise(highest)
        )

    each = lambda n: [holds(low, r.lower()) for r in lx.CONTEXTS[n]]
    read = rule(lambda n: reduce(lambda a, b: a | b, each(n)), lambda n: reduce(lambda a, b: a + b, [h.cast("int") for h in each(n)]))
    return read if known is None else F.when(known.isNull(), read).otherwise(rule(lambda n: known[n] > 0, lambda n: known[n]))


def _one(value: Column, make) -> Column:
    """make(value), which is costly, in a lambda: there a value is made once, and so many expressions don't swell generated code beyond what is compiled."""
    return F.get(F.transform(F.array(value), make), 0)


def usage_context(hits: DataFrame, text: str = "context") -> DataFrame:
    """hits with usage_context."""
    return hits.withColumn("usage_context", _one(F.lower(text), lambda low: use_of(low, F.col("pattern"))))


def contextual_risk(base: Column, use: Column) -> Column:
    """The base risk times the factor of the use, kept within 0.1 and 1; unknown uses keep the base."""
    factor = F.coalesce(*[F.when(use == n, F.lit(m)) for n, m in lx.MULTIPLIERS.items()], F.lit(1.0))
    return F.when(use == "unknown", base).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), base * factor)))


def is_nested(code: str = "code") -> Column:
    """Whether the 200 characters before `position` open an expression."""
    start = F.greatest(F.col("position") - 200, F.lit(0))
    return _opens(F.substring(F.col(code), start + 1, F.col("position") - start))


def _opens(before: Column) -> Column:
    return reduce(lambda a, b: a | b, [holds(before, r) for r in lx.NESTED])


def risk_factors(use: Column, nested: Column) -> Column:
    """Factors of the use, and one more for a nested token."""
    none = F.array().cast("array<string>")
    own = F.coalesce(*[F.when(use == n, F.array(*map(F.lit, f))) for n, f in lx.FACTORS.items()], none)
    return F.concat(own, F.when(nested, F.array(F.lit("complex_expression"))).otherwise(none))


#: Columns of a hit besides contract_id.
HIT = [
    "node_id", "source_type", "pattern", "position", "matched_text", "context_type", "context_name", "snippet", "risk_level",
    "base_risk", "contextual_risk", "usage_context", "cwe", "description", "is_nested", "risk_factors", "kind",
]


def combined(contracts: DataFrame, code: str = "code") -> DataFrame:
    """contracts with rule, position, text: a row for each match of the combining expressions."""

    def ruled(k: int, regex: str) -> Column:
        found = matches(code, UNIX_ANYCASE + regex)
        return F.transform(found, lambda m: F.struct(F.lit(k).alias("rule"), m["position"].alias("position"), m["text"].alias("text")))

    found = F.concat(*[ruled(k, r) for k, r in enumerate(lx.COMBINED)])
    return exploded(contracts, found, "m").select("*", "m.rule", "m.position", "m.text").drop("m")


def individual_sources(text: Column) -> Column:
    """Tokens that a combined expression contains, as substrings, in lexicon order."""
    return F.filter(F.array(*[F.lit(p) for p, *_ in lx.LEXICON]), lambda t: F.contains(text, t))


#: The kinds of hits, in the order in which they are reported.
KINDS = ("token", "combined", "state")


def _kinds_sql(rows: list[tuple], kinds: tuple[str, ...]) -> str:
    """SQL for one array of the hits of all kinds: kind, position, text, context (of tokens), name (of state variables), pattern."""
    null = "cast(null as string)"
    found = []
    if "token" in kinds:
        fields = f"'kind', 'token', 'position', f.position, 'text', f.text, 'name', {null}, 'pattern', f.text"
        found.append(_around("code", matches_sql("code", UNIX + token_alternation(rows)), 200, fields))
    if "combined" in kinds:
        for regex in lx.COMBINED:
            fields = f"'kind', 'combined', 'position', m.position, 'text', m.text, 'name', {null}, 'pattern', 'combined_sources', 'context', {null}"
            found.append(f"transform({matches_sql('code', UNIX_ANYCASE + regex)}, m -> named_struct({fields}))")
    if "state" in kinds:
        fields = f"'kind', 'state', 'position', m.position, 'text', m.text, 'name', m.g2, 'pattern', p, 'context', {null}"
        tokens_of = f"filter(array({', '.join(_quoted(p) for p, *_ in rows)}), p -> instr(m.g3, p) > 0)"
        every = f"flatten(transform({matches_sql('code', UNIX_LINES + lx.STATE_VARIABLE, (0, 2, 3))}, m -> transform({tokens_of}, p -> named_struct({fields}))))"
        # Of hits with one name and token the last stays: the one that another one follows in this order goes.
        order = "(x, y) -> case when x.name < y.name or x.name = y.name and x.pattern < y.pattern or x.name = y.name and x.pattern = y.pattern and x.position < y.position then -1 when x = y then 0 else 1 end"
        last = "filter(h, (x, i) -> i + 1 = size(h) or h[i + 1].name <> x.name or h[i + 1].pattern <> x.pattern)"
        found.append(f"transform(array(array_sort({every}, {order})), h -> {last})[0]")
    return f"concat({', '.join(found)})"


def detect(contracts: DataFrame, rows: list[tuple] = lx.LEXICON, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """contract_id and the columns HIT of all hits of a contract: tokens, combined expressions, state variables.

    Each contract is read in one row for all kinds, and only hits leave it. One place may be reported by several combining expressions; of
    state variables with equal node_ids the last stays.
    """
    def told(h: Column) -> Column:
        token, low = h["kind"] == "token", F.lower(h["context"])
        use = F.when(token, _one(low, lambda x: use_of(x, h["pattern"]))).when(h["kind"] == "combined", "randomness").otherwise("state_initialization")
        # A context begins with the (at most) 200 characters before its token.
        nested = F.when(token, _one(F.substring(h["context"], F.lit(1), F.least(h["position"], F.lit(200))), _opens)).otherwise(h["kind"] == "combined")
        same = [h[c].alias(c) for c in ("kind", "position", "text", "name", "pattern")]
        return F.struct(*same, F.substring(h["context"], 1, 200).alias("near"), use.alias("usage_context"), nested.alias("is_nested"))

    # Made before the rows are: what an expression makes in an array is made once, however often it is named later.
    found = F.transform(F.expr(_kinds_sql(rows, kinds)), told)
    each = exploded(contracts.select("contract_id", found.alias("_hits")), F.col("_hits"), "h").select("contract_id", "h.*")
    kind = F.col("kind")
    each = each.withColumn("about", _about(rows, F.col("pattern")))
    base = F.when(kind == "combined", F.lit(0.95)).when(kind == "state", F.col("about.base_risk") * 0.8).otherwise(F.col("about.base_risk"))
    each = each.withColumn("base_risk", base)
    risk = F.when(kind == "token", contextual_risk(F.col("base_risk"), F.col("usage_context"))).otherwise(F.col("base_risk"))
    each = each.withColumn("contextual_risk", risk)
    token = F.translate("pattern", ".", "_")
    by = lambda token, combined, state: F.when(kind == "token", token).when(kind == "combined", combined).otherwise(state)
    names = by(F.concat(F.lit("source_"), token, F.lit("_"), "position"), F.concat(F.lit("source_combined_"), "position"), F.concat(F.lit("source_state_"), "name", F.lit("_"), token))
    state_factors = F.array(F.lit("state_variable"), F.lit("initialization"))
    return each.select(
        "contract_id",
        names.alias("node_id"),
        F.when(kind == "combined", "combined").otherwise(F.col("about.source_type")).alias("source_type"),
        "pattern",
        "position",
        F.when(kind == "state", F.col("pattern")).otherwise(F.col("text")).alias("matched_text"),
        F.when(kind == "state", "state").otherwise("function").alias("context_type"),
        F.coalesce("name", F.lit("unknown")).alias("context_name"),
        F.coalesce("near", "text").alias("snippet"),
        F.when(kind == "combined", "critical").otherwise(risk_level(F.col("contextual_risk"))).alias("risk_level"),
        "base_risk",
        "contextual_risk",
        "usage_context",
        F.lit(lx.CWE).alias("cwe"),
        by(F.col("about.description"), F.lit("Multiple randomness sources combined"), F.concat(F.lit("State variable initialized with "), "pattern")).alias("description"),
        "is_nested",
        by(risk_factors(F.col("usage_context"), F.col("is_nested")), F.array(F.lit("combined_sources"), F.lit("high_predictability")), state_factors).alias("risk_factors"),
        "kind",
    )


def token_hits(contracts: DataFrame, rows: list[tuple] = lx.LEXICON) -> DataFrame:
    """contract_id and the columns HIT for every token of every contract."""
    return detect(contracts, rows, ("token",))


def combined_hits(contracts: DataFrame) -> DataFrame:
    """contract_id and the columns HIT for every combined expression; one place may be reported by several rules."""
    return detect(contracts, kinds=("combined",))


def state_variable_hits(contracts: DataFrame) -> DataFrame:
    """contract_id and the columns HIT for state variables whose initial value holds a token; of equal node_ids the last stays."""
    return detect(contracts, kinds=("state",))


def statistics(hits: DataFrame) -> DataFrame:
    """contract_id, total_sources, nested_sources, by_type, by_risk. State variables count in total and by type only."""
    counted = F.col("kind") != "state"
    per = hits.groupBy("contract_id", "source_type", "risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(counted).alias("ranked"), F.count_if(counted & F.col("is_nested")).alias("nested")
    )
    # A row for each type and level of a contract, of which there are few.
    rows = per.groupBy("contract_id").agg(F.collect_list(F.struct("source_type", "risk_level", "n", "ranked", "nested")).alias("e"))
    total = lambda e, field: F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x[field])

    def by(name: str, field: str) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(F.filter("e", lambda x: x[field] > 0), lambda x: x[name])))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: total(F.filter("e", lambda x: x[name] == k), field)))

    sums = total(F.col("e"), "n").alias("total_sources"), total(F.col("e"), "nested").alias("nested_sources")
    return rows.select("contract_id", *sums, by("risk_level", "ranked").alias("by_risk"), by("source_type", "n").alias("by_type"))


def statistics_long(hits: DataFrame) -> DataFrame:
    """The same counts in long form by grouping sets: (contract, type), (contract, risk), (contract)."""
    counted = F.col("kind") != "state"
    return (
        hits.groupingSets([["contract_id", "source_type"], ["contract_id", "risk_level"], ["contract_id"]], "contract_id", "source_type", "risk_level")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(counted).alias("ranked"), F.count_if(counted & F.col("is_nested")).alias("nested"))
    )


def functions(contracts: DataFrame) -> DataFrame:
    """contract_id, function, body: of equal names the last, and the first constructor in place of any such name."""
    regex, build = _quoted(UNIX + lx.FUNCTION), _quoted(UNIX + lx.CONSTRUCTOR)
    # All functions are found once; then, last first, those whose name came already are left out: no shuffle.
    kept = F.expr(
        f"""transform(array(concat(
              transform(arrays_zip(regexp_extract_all(code, {regex}, 1), regexp_extract_all(code, {regex}, 2)), f -> named_struct('function', f['0'], 'body', f['1'])),
              transform(slice(regexp_extract_all(code, {build}, 1), 1, 1), b -> named_struct('function', 'constructor', 'body', b)))), found ->
              aggregate(reverse(found), cast(array() as array<struct<function:string,body:string>>),
                        (a, f) -> if(exists(a, g -> g.function = f.function), a, array_append(a, f))))[0]"""
    )
    return exploded(contracts, kept, "f").select("contract_id", "f.function", "f.body")


#: Bodies of fewer characters are a context as a whole; in others it is what stands within REACH of the token.
SHORT, REACH = 2000, 1000


#: The characters that Unicode calls white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def statement(window: Column, lead: Column, pattern: Column) -> Column:
    """The part of a window between the semicolons around its token, which begins after `lead` characters, trimmed (X11)."""
    end = lead + F.length(pattern)
    # What stands after the last semicolon before the token, and before the first one after it.
    before = F.substring_index(F.substring(window, F.lit(1), lead), ";", -1)
    after = F.substring_index(F.substring(window, end + 1, F.lit(2 * REACH)), ";", 1)
    return F.btrim(F.concat(before, pattern, after), F.lit(BLANKS))


def body_hits(bodies: DataFrame) -> DataFrame:
    """bodies without body, with kind, position, line, text, near, usage_context, is_nested: a row for each token and combined expression (X11).

    A body is read once, in its own row. Lines are running sums over the pieces between hits; the context of a hit is cut from the text
    within REACH of it, or is the whole of a SHORT body, whose expressions are then counted once for all its tokens. A row carries
    the first 200 characters of its context, not the body.
    """
    short = "_short"  # told once: the length of a body counts its characters
    found = matches_sql("body", UNIX + token_alternation(lx.LEXICON), lines=True)
    fields = f"'kind', 'token', 'position', f.position, 'line', f.line, 'text', f.text, 'lead', if({short}, f.position, least(f.position, {REACH}))"
    near = _around("body", found, REACH, fields, 2 * PIECE)
    whole = f"transform({near}, h -> named_struct('kind', h.kind, 'position', h.position, 'line', h.line, 'text', h.text, 'lead', h.lead, 'context', if({short}, body, h.context)))"
    rules = [
        f"transform({matches_sql('body', UNIX_ANYCASE + r, lines=True)}, m -> named_struct('position', m.position, 'rule', {k}, 'line', m.line, 'text', m.text))"
        for k, r in enumerate(lx.COMBINED)
    ]
    # One place that several rules report has one id in a function: the last rule's text stays.
    last = f"transform(array(array_sort(concat({', '.join(rules)}))), c -> filter(c, (x, i) -> i + 1 = size(c) or c[i + 1].position <> x.position))[0]"
    both = f"transform({last}, x -> named_struct('kind', 'combined', 'position', x.position, 'line', x.line, 'text', x.text, 'lead', 0, 'context', x.text))"
    def told(h: Column, known: Column) -> Column:
        token, before = h["kind"] == "token", F.substring(h["context"], F.greatest(h["lead"] - 200, F.lit(0)) + 1, F.least(h["lead"], F.lit(200)))
        context = F.when(token & ~F.col("_short"), statement(h["context"], h["lead"], h["text"])).otherwise(h["context"])
        same = [h[c].alias(c) for c in ("kind", "position", "line", "text")]

        def within(context: Column) -> Column:
            use = F.when(token, _one(F.lower(context), lambda low: use_of(low, h["text"], known))).otherwise("randomness")
            return F.struct(*same, F.substring(context, 1, 200).alias("near"), use.alias("usage_context"), F.when(token, _one(before, _opens)).otherwise(True).alias("is_nested"))

        return _one(context, within)

    def every(hits: Column) -> Column:
        some = F.col("_short") & F.exists(hits, lambda h: h["kind"] == "token")
        known = F.when(some, _one(F.lower("body"), lambda low: F.struct(*[c.alias(n) for n, c in scores(low).items()])))
        return _one(known, lambda k: F.transform(hits, lambda h: told(h, k)))

    others = [c for c in bodies.columns if c != "body"]
    told_short = bodies.withColumn("_short", F.length("body") < SHORT)
    read = told_short.select(*others, _one(F.expr(f"concat({whole}, {both})"), every).alias("_hits"))
    return exploded(read, F.col("_hits"), "h").select(*others, "h.*")


def function_hits(bodies: DataFrame) -> DataFrame:
    """contract_id, function, node_id, ..., line_number, individual_sources for every hit inside function bodies (contract_id, function, body) (X11)."""
    token = F.col("kind") == "token"
    each = body_hits(bodies).withColumn("about", _about(lx.LEXICON, F.col("text")))
    each = each.withColumn("base_risk", F.when(token, F.col("about.base_risk")).otherwise(0.95))
    risk = F.when(token, contextual_risk(F.col("base_risk"), F.col("usage_context"))).otherwise(F.col("base_risk"))
    name = F.when(token, F.translate("text", ".", "_")).otherwise("combined")
    return each.select(
        "contract_id",
        "function",
        F.concat_ws("_", F.lit("source"), name, F.col("function"), F.col("position")).alias("node_id"),
        F.when(token, F.col("about.source_type")).otherwise("combined").alias("source_type"),
        F.when(token, F.col("text")).otherwise("combined_sources").alias("pattern"),
        "position",
        F.col("line").alias("line_number"),
        "base_risk",
        risk.alias("contextual_risk"),
        "usage_context",
        F.when(token, F.col("near")).otherwise(F.col("text")).alias("snippet"),
        "is_nested",
        F.when(token, risk_factors(F.col("usage_context"), F.col("is_nested"))).otherwise(F.array(F.lit("combined_sources"), F.lit("high_predictability"))).alias("risk_factors"),
        F.when(token, F.array().cast("array<string>")).otherwise(individual_sources(F.col("text"))).alias("individual_sources"),
    )


def extended_hits(contracts: DataFrame) -> DataFrame:
    """contract_id, pattern, position, usage_context, controller, level, misuse of the opt-in sources."""
    rows = [(p, "extended", 0.5, misuse) for p, _, _, misuse in lx.EXTENDED]
    used = usage_context(token_contexts(contracts, rows))
    about = {p: (c, level) for p, c, level, _ in lx.EXTENDED}
    return used.select(
        "contract_id", "pattern", "position", "usage_context",
        F.coalesce(*[F.when(F.col("pattern") == p, F.lit(c)) for p, (c, _) in about.items()]).alias("controller"),
        F.coalesce(*[F.when(F.col("pattern") == p, F.lit(level)) for p, (_, level) in about.items()]).alias("level"),
        F.col("description").alias("misuse"),
    )


#: Files whose names are broadcast at most to find their code; more are joined by shuffle.
MAX_BROADCAST_FILES = 1_000_000


def match_code(asts: DataFrame, contracts: DataFrame) -> DataFrame:
    """asts (file_name) joined with the contract of that file, the first by path if several; code is null without one.

    Which file belongs to which document is found by names alone; then only the code of those files is joined.
    """
    first = contracts.groupBy("file_name").agg(F.min("path").alias("path"))  # no text in this shuffle
    named = first.join(asts.select("file_name").distinct(), "file_name", "left_semi")
    few = named.count() <= MAX_BROADCAST_FILES
    code = contracts.select("file_name", "path", "code").join(F.broadcast(named) if few else named, ["file_name", "path"], "left_semi")
    return asts.join(code, "file_name", "left")


def unmatched(asts: DataFrame, contracts: DataFrame) -> DataFrame:
    """asts without any contract: rows of the error report."""
    return asts.join(contracts.select("file_name"), "file_name", "left_anti")


def risk_summary(hits: DataFrame) -> DataFrame:
    """usage_context, risk_level, n_hits, n_contracts, avg_risk: the flagship report."""
    return hits.groupBy("usage_context", "risk_level").agg(
        F.count(F.lit(1)).alias("n_hits"), F.countDistinct("contract_id").alias("n_contracts"), F.round(F.avg("contextual_risk"), 6).alias("avg_risk")
    )
