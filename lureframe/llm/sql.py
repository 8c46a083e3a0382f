"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

SPACE = r"\x20\x09-\x0D"


def crc32(points: str) -> str:
    """CRC-32 of a list of bytes, from a table that eight shifts per entry give."""
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    step = "lambda c, b: xor(c >> 8, table_of[(xor(c, b) & 255) + 1])"
    return f"(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, {points}), {step}), 4294967295) FROM (SELECT {table} AS table_of))"


def _edit(way: str, cost: int | str, letter: str) -> str:
    """A way is its cost in eight digits and its letters, so that least() compares cost, then letters."""
    return f"lpad(CAST(CAST(left({way}, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr({way}, 9) || '{letter}'"


def _row(state: str, letter: str, cost: int, role: str = "", damage: bool = False) -> str:
    allowed = " AND ".join([*(["NOT gone"] if damage else []), *([f"initial = '{role}'"] if role else [])])
    made = _edit(state, f"{cost} + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END" if damage else cost, letter)
    return f"CASE WHEN {allowed} THEN {made} END" if allowed else made


REPAIR = rf"""
    WITH RECURSIVE plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {crc32("list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: unicode(c)::BIGINT)")} % 20 AS fate FROM conversations),
         damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                 CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM plain),
         placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn FROM damaged),
         marked AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS earlier,
                 CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 'blank'
                      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
                      WHEN regexp_extract(text, '([^{SPACE}])[{SPACE}]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
         facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
         ways AS (SELECT conv_id, 0 AS rn, '00000000' AS w0, CAST(NULL AS VARCHAR) AS w1, '00000005I' AS w2, '00000010II' AS w3 FROM facts
             UNION ALL
             SELECT conv_id, rn, n0, n1, w2, least(n3, {_edit("w2", 5, "I")})
             FROM (SELECT *, least(n2, {_edit("n0", 5, "I")}, {_edit("n1", 5, "I")}, {_edit("n3", 5, "I")}) AS w2
                   FROM (SELECT m.conv_id, m.rn, {_row("w0", "D", 2)} AS n0, least({_row("w1", "D", 2)}, {_row("w0", "K", 0, "s", True)}) AS n1,
                             least({_row("w2", "D", 2)}, {", ".join(_row(w, *x) for w in ("w0", "w1", "w3") for x in (("K", 0, "u", True), ("R", 1, "", True)))}) AS n2,
                             least({_row("w3", "D", 2)}, {_row("w2", "K", 0, "a", True)}, {_row("w2", "R", 1, "", True)}) AS n3
                         FROM (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone FROM marked) m
                         JOIN ways w ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.rn = w.rn + 1))),
         best AS (SELECT f.*, least(w0, w3) AS way FROM facts f JOIN ways w ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.rn),
         letters AS (SELECT conv_id, substr(way, 9) AS audit, unnest(range(1, length(way) - 7)) AS nth, substr(substr(way, 9), unnest(range(1, length(way) - 7)), 1) AS letter FROM best),
         numbered AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY nth) AS rn,
                 count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY nth) AS line FROM letters),
         kept AS (SELECT n.conv_id, n.nth, n.line, n.letter, m.role, m.text, m.initial FROM numbered n
                  LEFT JOIN marked m ON n.conv_id IS NOT DISTINCT FROM m.conv_id AND n.rn = m.rn AND n.letter <> 'I' WHERE n.letter <> 'D'),
         lines AS (SELECT *, line - CASE WHEN bool_or(line = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS place FROM kept),
         made AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY nth) AS whole
                  FROM lines GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(CAST(left(way, 8) AS BIGINT), 0) AS cost, coalesce(substr(way, 9), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
    LEFT JOIN made m ON c.conv_id IS NOT DISTINCT FROM m.conv_id"""

#: Words one edit apart: equal after each loses the code point at one place, or one equals the other less a code point.
SPELLING = rf"""
    WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS k FROM (
             SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
         hashed AS (SELECT run, k, {crc32("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END))")} AS h FROM runs),
         vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
             SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM hashed)
             WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
         less AS (SELECT word, length(word) AS size, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM vocab)),
         pairs AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
             UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM vocab) UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM vocab)),
         near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS best, max(n) AS best_n FROM pairs JOIN vocab ON b = word GROUP BY a),
         formed AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
                    FROM vocab v LEFT JOIN near USING (word)),
         steps AS (SELECT word, word AS root FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON s.root = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, form, s.root, n, n_near, form_n FROM formed f JOIN (SELECT s.word, s.root FROM steps s JOIN formed e ON s.root = e.word WHERE e.form IS NULL) s ON f.word = s.word"""


def near_sql(words: int, percent: int, columns: str) -> str:
    """Documents linked by the similarity of their distinct shingles, and the smallest doc_id that each reaches."""
    return rf"""
    WITH RECURSIVE listed AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') AS w FROM documents),
         sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' '))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM listed),
         sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
         shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
         links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= {percent} * (x.n + y.n - k)),
         reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN links ON other = a),
         least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, {columns} FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""


ORACLE: dict[str, str] = {
    "op5_near_dedup": near_sql(3, 85, "component_id, d.doc_id = component_id AS kept"),
    "op12_jaccard_join": near_sql(4, 85, "component_id"),
    "op11_spelling_variants": SPELLING,
    "op13_conversation_repair": REPAIR,
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
