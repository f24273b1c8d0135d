"""Chat formatting with array expressions only.

Turns of a conversation are collected as structs and sorted, neighbours of one role are
merged into a block, blocks are joined to one string.  Every mark of the template starts with
``[`` or ``<``; where a text holds such a mark, one backslash is put behind that character
(and one more where backslashes stand there already), so no text can be taken for a mark and
the texts come back exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Role: opening and closing mark.  Other roles are written by name.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
BEGIN, NEXT, ROLE, TEXT, ROLE_END = "<s>", "[+]", "[ROLE]", "[TEXT]", "[/ROLE]"
_REST = r"(?:/?(?:SYS|INST|ROLE)|OUT|TEXT|\+)\]|/?s>"
LEARNED = "assistant"
#: Elements of an array that are summed or cut in one go.
RUN = 64


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, r'([\[<])(\\*)({_REST})', r'$1\\$2$3')"


def _unescaped(text: str) -> str:
    return rf"regexp_replace({text}, r'([\[<])\\(\\*)({_REST})', '$1$2$3')"


def _by_role(role: str, which: int, other: str) -> str:
    cases = " ".join(f"WHEN '{r}' THEN '{m[which]}'" for r, m in MARKS.items())
    return f"CASE {role} {cases} ELSE {other} END"


def _runs(array: str, size: int) -> str:
    """The array's elements in consecutive runs of ``size``; none for an empty array."""
    first = f"filter(sequence(0, size({array}) div {size}), c -> c * {size} < size({array}))"
    return f"transform({first}, c -> slice({array}, c * {size} + 1, {size}))"


def _placed(pieces: str) -> str:
    """Places (start, end) of the learned texts: running sums inside runs, then over the runs.

    An array grown element by element is copied each time, so sums over one run stay short.
    """
    place = "struct<start:bigint,end:bigint,learned:boolean>"
    run = f"struct<at:bigint,places:array<{place}>>"
    inside = f"""transform({_runs(pieces, RUN)}, g -> aggregate(g,
        CAST(named_struct('at', 0, 'places', array()) AS {run}),
        (s, p) -> CAST(named_struct('at', s.at + p.before + p.long + p.after,
            'places', concat(s.places, array(named_struct('start', s.at + p.before,
                'end', s.at + p.before + p.long, 'learned', p.learned)))) AS {run})))"""
    begins = f"""aggregate(transform(runs, g -> g.at),
        CAST(named_struct('at', {len(BEGIN)}, 'begins', array()) AS struct<at:bigint,begins:array<bigint>>),
        (s, n) -> CAST(named_struct('at', s.at + n, 'begins', concat(s.begins, array(s.at)))
            AS struct<at:bigint,begins:array<bigint>>)).begins"""
    return f"""flatten(transform(array({inside}), runs -> transform(
        filter(flatten(zip_with(runs, {begins}, (g, b) -> transform(g.places,
            x -> named_struct('start', x.start + b, 'end', x.end + b, 'learned', x.learned)))), x -> x.learned),
        x -> named_struct('start', x.start, 'end', x.end))))"""


def _cut(text: str, spans: str) -> str:
    """The texts under ascending spans, by stretches of stretches.

    A place in a string is found by counting from its start, so a long string is cut into
    stretches before single spans are cut.
    """
    stretches = f"array(named_struct('at', CAST(0 AS BIGINT), 'text', {text}, 'spans', {spans}))"
    for size in (RUN * RUN, RUN):
        stretches = f"""flatten(transform({stretches}, g -> transform({_runs('g.spans', size)}, r -> named_struct(
            'at', r[0].start,
            'text', substr(g.text, CAST(r[0].start - g.at + 1 AS INT), CAST(r[size(r) - 1].end - r[0].start AS INT)),
            'spans', r))))"""
    return f"""flatten(transform({stretches}, g -> transform(g.spans,
        s -> substr(g.text, CAST(s.start - g.at + 1 AS INT), CAST(s.end - s.start AS INT)))))"""


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``(conv_id, formatted, loss_spans)``.

    ``turns`` has conv_id, turn, role, text; other columns are ignored.  Null role or text
    counts as empty, a null turn comes first, equal turn numbers follow role and text, and
    repeated rows stay.  Rows without conv_id form one conversation of their own.
    ``loss_spans`` holds (start, end) in code points of each assistant text as written.  No
    rows give no conversations.  A conversation is one cell, whatever its length.
    """
    opened = _by_role("b.role", 0, f"concat('{ROLE}', {_escaped('b.role')}, '{TEXT}')")
    closed = _by_role("b.role", 1, f"'{ROLE_END}'")
    return (
        turns.select(
            "conv_id",
            F.struct(
                "turn",
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .withColumn(
            "starts",
            F.expr(
                "filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role <> turns[i - 2].role)"
            ),
        )
        .withColumn(
            "blocks",
            F.expr(
                f"""transform(starts, (s, j) -> named_struct(
                    'role', turns[s - 1].role,
                    'texts', transform(
                        slice(turns, s, coalesce(get(starts, j + 1), size(turns) + 1) - s),
                        t -> {_escaped('t.text')})))"""
            ),
        )
        .withColumn(
            "written",
            F.expr(
                f"""transform(blocks, b -> named_struct('role', b.role, 'texts', b.texts,
                    'open', {opened}, 'body', array_join(b.texts, '{NEXT}'), 'close', {closed}))"""
            ),
        )
        .withColumn(
            "pieces",
            F.expr(
                f"""flatten(transform(written, w -> transform(w.texts, (t, i) -> named_struct(
                    'learned', w.role = '{LEARNED}',
                    'before', CAST(IF(i = 0, length(w.open), {len(NEXT)}) AS BIGINT),
                    'long', CAST(length(t) AS BIGINT),
                    'after', CAST(IF(i = size(w.texts) - 1, length(w.close), 0) AS BIGINT)))))"""
            ),
        )
        .select(
            "conv_id",
            F.expr(
                f"concat('{BEGIN}', array_join(transform(written, w -> concat(w.open, w.body, w.close)), ''))"
            ).alias("formatted"),
            F.expr(_placed("pieces")).alias("loss_spans"),
        )
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """Turns and learned text read back from ``formatted`` and ``loss_spans`` alone.

    Adds ``turns`` (role, text; in order, merged blocks taken apart) and ``loss_text``.
    """
    marks = [(r, o, c) for r, (o, c) in MARKS.items()]
    role = " ".join(f"WHEN startswith(p, '{o}') THEN '{r}'" for r, o, _ in marks)
    named = f"substring_index(substr(p, {len(ROLE) + 1}), '{TEXT}', 1)"
    body = " ".join(
        f"WHEN startswith(p, '{o}') THEN substr(p, {len(o) + 1}, length(p) - {len(o) + len(c)})"
        for _, o, c in marks
    )
    skipped = f"({len(ROLE) + len(TEXT)} + length({named}))"
    other = f"substr(p, {skipped} + 1, length(p) - {skipped} - {len(ROLE_END)})"
    return (
        chats.withColumn("_split", F.expr(r"split(formatted, r'(?=\[(?:SYS|INST|OUT|ROLE)\])')"))
        .withColumn("_parts", F.expr("slice(_split, 2, greatest(0, size(_split) - 1))"))
        .withColumn(
            "turns",
            F.expr(
                rf"""flatten(transform(_parts, p -> transform(
                    split(CASE {body} ELSE {other} END, r'\[\+\]', -1),
                    x -> named_struct(
                        'role', CASE {role} ELSE {_unescaped(named)} END,
                        'text', {_unescaped('x')}))))"""
            ),
        )
        .withColumn(
            "loss_text",
            F.expr(
                f"array_join(transform({_cut('formatted', 'loss_spans')}, x -> {_unescaped('x')}), '')"
            ),
        )
        .drop("_parts", "_split")
    )
