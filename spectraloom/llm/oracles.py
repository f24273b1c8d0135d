"""The same results as DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_REST = r"(?:/?(?:SYS|INST|ROLE)|OUT|TEXT|\+)\]|/?s>"


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([\[<])(\\*)({_REST})', '\1\\\2\3', 'g')"


CHAT = f"""WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 3 ELSE CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13
        WHEN 'assistant' THEN 9 ELSE 19 + length({_escaped('role')}) END END + length({_escaped('text')}) AS chars
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM u GROUP BY conv_id"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM r WHERE place <= 10"""


def jaccard(k: int, percent: int) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=lower)} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct(
    list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets
    JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""


def mixing(weights: Mapping[str, Mapping[str, int]], percent: int, epochs: int, seed: int) -> str:
    levels = ["domain", "lang", "source"]
    number = "coalesce(try_cast(regexp_extract(coalesce(source, ''), '[0-9]+$') AS BIGINT), 0)"
    parts = [
        f"""d AS (SELECT doc_id, 'd' || ({number} % 3) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CAST(len({WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS tokens FROM documents)""",
        f"""leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS available,
        sum(tokens)::HUGEINT * {epochs} AS cap FROM d GROUP BY ALL)""",
        f"g0 AS (SELECT least(sum(available) * {percent} // 100, sum(cap))::HUGEINT AS given FROM leaf)",
    ]
    for i, level in enumerate(levels, start=1):
        path, parent = ", ".join(levels[:i]), ", ".join(levels[: i - 1])
        named = " ".join(f"WHEN '{v}' THEN {w}" for v, w in weights[level].items() if v != "*")
        rest = weights[level].get("*", 1)
        weight = f"CASE {level} {named} ELSE {rest} END" if named else str(rest)
        split = f"PARTITION BY {parent}" if parent else ""
        joined = f"JOIN g{i - 1} USING ({parent})" if parent else ", g0"
        parts += [
            f"""c{i} AS (SELECT * FROM (SELECT {path}, sum(cap)::HUGEINT AS cap, sum(available)::HUGEINT AS available,
            ({weight})::HUGEINT AS weight FROM leaf GROUP BY {path}) {joined})""",
            f"""a{i} AS (SELECT *, coalesce(sum(cap) OVER o, 0)::HUGEINT AS before,
            (sum(weight) OVER ({split}) - coalesce(sum(weight) OVER o, 0))::HUGEINT AS remaining FROM c{i}
            WINDOW o AS ({split} ORDER BY cap::DOUBLE / weight::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
            f"b{i} AS (SELECT *, cap * remaining <= (given - before) * weight AS filled FROM a{i})",
            f"""e{i} AS (SELECT *, given - coalesce(sum(cap) FILTER (filled) OVER ({split}), 0)::HUGEINT AS pool,
            coalesce(sum(weight) FILTER (NOT filled) OVER ({split}), 0)::HUGEINT AS shares FROM b{i})""",
            f"t{i} AS (SELECT *, CASE WHEN filled THEN cap ELSE pool * weight // shares END AS take FROM e{i})",
            f"""g{i} AS (SELECT {path}, available, CASE WHEN NOT filled AND
            row_number() OVER ({split} ORDER BY filled, {level}) <= pool - coalesce(sum(take) FILTER (NOT filled) OVER ({split}), 0)
            THEN take + 1 ELSE take END::HUGEINT AS given FROM t{i})""",
        ]
    parts.append(
        """plan AS (SELECT domain, lang, source, given AS budget, given // available AS whole,
        given - (given // available) * available AS remainder FROM g3 WHERE available > 0)"""
    )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT doc_id, domain, lang, source, tokens, CAST(budget AS BIGINT) AS budget, CAST(copies AS BIGINT) AS copies FROM (
    SELECT *, whole + CAST(coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY
        md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < remainder AS INT) AS copies
    FROM d JOIN plan USING (domain, lang, source)) WHERE copies > 0"""
    )


def quality(
    common: tuple[str, ...], char_limit: tuple[float, float], word_limit: tuple[float, float], least: tuple[int, int]
) -> str:
    def count(pattern: str) -> str:
        return f"length(regexp_replace(t, '[^{pattern}]', '', 'g'))"

    classes = ["a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r".,;:!?''\"()\-", r"#*$%&|<>"]
    chars = ", ".join(f"c{i}::DOUBLE" for i in range(6)) + ", (length(t) - c0 - c1 - c2 - c3 - c4 - c5)::DOUBLE"
    spoken = ", ".join(f"len(list_filter(bare, lambda x: x = '{w}'))::DOUBLE" for w in common)
    listed = ", ".join(f"'{w}'" for w in common)

    def sums(name: str, n: int) -> str:
        return "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"

    def distance(hist: str, ref: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
        p, q = f"{hist}[i] / list_sum({hist})", f"{ref}[i] / list_sum({ref})"
        term = f"{part.format(f'({p})', f'({q})')} + {part.format(f'({q})', f'({p})')}"
        return f"sqrt(greatest(0, 0.5 * list_sum(list_transform(range(1, len({hist}) + 1), lambda i: {term}))))"

    def kept(name: str, limit: tuple[float, float]) -> str:
        return f"coalesce({name}, 0) <= {limit[0]} + {limit[1]} / sqrt(greatest(n_words, 1))"

    counted = ", ".join(f"{count(c)} AS c{i}" for i, c in enumerate(classes))
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {WORDS.format(text='t')} AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    {counted} FROM d),
b AS (SELECT *, list_transform(words, lambda x: lower(regexp_replace(x, '[.,;:!?]+$', ''))) AS bare FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM
    (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1) GROUP BY 1),
f AS (SELECT doc_id, lang, len(words)::BIGINT AS n_words, (length(t) - c3)::BIGINT AS word_chars, c5::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    [{chars}] AS ch, [{spoken}, (len(words) - len(list_filter(bare, lambda x: x IN ({listed}))))::DOUBLE] AS wh
    FROM b LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
r AS (SELECT lang, {sums('ch', 7)} AS cr, {sums('wh', len(common) + 1)} AS wr FROM g WHERE NOT base_failed GROUP BY 1),
j AS (SELECT *, CASE WHEN n_words >= {least[0]} AND word_chars >= {least[1]} THEN {distance('ch', 'cr')} END AS cd,
    CASE WHEN n_words >= {least[0]} AND word_chars >= {least[1]} THEN {distance('wh', 'wr')} END AS wd FROM g LEFT JOIN r USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {kept('cd', char_limit)} AND {kept('wd', word_limit)} AS kept,
    round(cd, 6) + 0.0 AS char_distance, round(wd, 6) + 0.0 AS word_distance FROM j"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: crc32 bit by bit: every eighth step takes in a character of the decimal id.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(CAST(doc_id AS VARCHAR))),
    lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1))::BIGINT ELSE 0::BIGINT END)),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT)"""

#: A lone node has no sibling: '' adds nothing to a digest.
MERKLE = f"""WITH RECURSIVE d AS (SELECT *, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")}
        ELSE {_leaf("n_chars")} END AS altered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
tree AS (SELECT 0 AS level, lang, pos AS spot, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM p
    UNION ALL SELECT level + 1, lang, spot // 2, sha256(digest || coalesce(other, '')), (n + 1) // 2 FROM (
        SELECT *, lead(digest) OVER (PARTITION BY lang ORDER BY spot) AS other FROM tree WHERE n > 1) WHERE spot % 2 = 0),
langs AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos AS spot, subroot AS digest, count(*) OVER () AS n FROM langs
    UNION ALL SELECT level + 1, spot // 2, sha256(digest || coalesce(other, '')), (n + 1) // 2 FROM (
        SELECT *, lead(digest) OVER (ORDER BY spot) AS other FROM top WHERE n > 1) WHERE spot % 2 = 0),
root AS (SELECT digest AS root FROM top WHERE n = 1),
fold AS (SELECT doc_id, lang, pos, 0 AS level, altered AS node, '' AS proof FROM p
    UNION ALL SELECT f.doc_id, f.lang, f.pos, f.level + 1,
        sha256(CASE WHEN (f.pos >> f.level) % 2 = 1 THEN s.digest || f.node ELSE f.node || coalesce(s.digest, '') END),
        f.proof || coalesce(s.digest, '') FROM fold f
    JOIN tree t ON t.level = f.level AND t.lang IS NOT DISTINCT FROM f.lang AND t.spot = f.pos >> f.level AND t.n > 1
    LEFT JOIN tree s ON s.level = f.level AND s.lang IS NOT DISTINCT FROM f.lang AND s.spot = xor(f.pos >> f.level, 1)),
own AS (SELECT * FROM (SELECT *, max(level) OVER (PARTITION BY lang, pos) AS height FROM fold) WHERE level = height),
up AS (SELECT o.doc_id, o.lang, o.pos, l.pos AS place, 0 AS level, o.node, o.proof FROM own o JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang
    UNION ALL SELECT f.doc_id, f.lang, f.pos, f.place, f.level + 1,
        sha256(CASE WHEN (f.place >> f.level) % 2 = 1 THEN s.digest || f.node ELSE f.node || coalesce(s.digest, '') END),
        f.proof || coalesce(s.digest, '') FROM up f
    JOIN top t ON t.level = f.level AND t.spot = f.place >> f.level AND t.n > 1
    LEFT JOIN top s ON s.level = f.level AND s.spot = xor(f.place >> f.level, 1)),
done AS (SELECT * FROM (SELECT *, max(level) OVER (PARTITION BY lang, pos) AS height FROM up) WHERE level = height)
SELECT p.doc_id, p.leaf, l.subroot, root, sha256(u.proof) AS proof_sha256, u.node AS folded_root, u.node = root AS verified
FROM p JOIN langs l ON p.lang IS NOT DISTINCT FROM l.lang JOIN done u ON u.lang IS NOT DISTINCT FROM p.lang AND u.pos = p.pos, root"""


def collocations(least: int, percent: int, top: int) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, unnest(flatten(list_transform(range(1, least(len(w), 4) + 1),
    lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) AS g FROM p WHERE len(w) > 0),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1 AND a >= {least}),
cut AS (SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score FROM c
    JOIN f x ON x.lang = c.lang AND x.g = c.g[:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a AS longer, unnest(flatten(list_transform(range(2, len(g)), lambda m:
    list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) AS g FROM f WHERE len(g) > 2 AND a >= {least}),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN
    (SELECT lang, g, max(longer) AS longer FROM inner_ GROUP BY ALL) USING (lang, g) WHERE longer IS NULL OR 100 * longer < {percent} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {top}"""
