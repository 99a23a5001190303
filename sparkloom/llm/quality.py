"""Line-first quality cleaning with DataFrame expressions only.

Each line is tested by three kinds of rule (punctuation and symbols, navigation,
boilerplate); failing lines are removed, and a document is rejected when the base
checks fail or when the removed lines held more than ``max_lost`` percent of its text.

Edge cases: a null text counts as empty (no words, base check failed, rejected). A
line without words is never removed. Repeated rows are judged alike, ties cannot occur; row
order plays no part. An empty table gives an empty result. Extra columns pass through under
any name but those of the outputs, which raise ValueError. A very long text is judged whole by
one task, which holds its words, lines and window hashes at once (about 20 bytes a word beside
the text); time grows in proportion to its length.

A line of prose that mentions a boilerplate phrase stays if it is longer than
``BOILERPLATE_CHARS``; a hard-wrapped line stays if the next line runs on; sentence ends of all
scripts count. Navigation and boilerplate are known in English, German, French and Spanish.
Rules are tried in order of cost, and most of them only in texts that hold one of their signs.

Words are the maximal runs outside space and U+0009..U+000D. Repeated five-word
windows are found inside the row: windows are hashed, and only in documents in which two
hashes agree the windows concerned are compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import column, fence

SPACE = r" \t-\r"
SYMBOLS = "#*$%&|<>"
#: A line's share of symbols (in percent of its non-space characters) from which it fails.
MAX_LINE_SYMBOLS = 10
#: A line of at least this many words must hold the end of a sentence.
LONG_LINE_WORDS = 8
MAX_LOST = 50
MIN_WORDS = 10
MAX_REPEATED = 20

LINE_SYMBOL_SET = r"[#*$%&|<>{}~^\\]"
LONG_LINE = rf"^[{SPACE}]*([^{SPACE}]+[{SPACE}]+){{{LONG_LINE_WORDS - 1}}}[^{SPACE}]"
CLOSED = rf"""[.!?…。！？]([{SPACE}"')\]»”’]|$)"""
MENU = r"^[^|»›•·]*([|»›•·][^|»›•·]{0,40}){2,}$"
#: Navigation: a line that is one of these entries; longer lines are not tried.
NAV_CHARS = 40
NAV_ENTRIES = (
    r"home|menu|log ?in|log ?out|sign ?in|sign ?up|register|search|site ?map|next|previous|back to top|read more|show more|share|print|"
    r"contact us|about us|skip to content|toggle navigation|table of contents|"
    r"startseite|menü|anmelden|abmelden|registrieren|suche|weiter|zurück|nach oben|weiterlesen|mehr anzeigen|teilen|drucken|kontakt|"
    r"impressum|über uns|zum inhalt springen|inhaltsverzeichnis|"
    r"accueil|connexion|déconnexion|inscription|rechercher?|suivant|précédent|haut de page|lire la suite|voir plus|partager|imprimer|"
    r"contactez[- ]nous|à propos|aller au contenu|plan du site|mentions légales|sommaire|"
    r"inicio|menú|iniciar sesión|cerrar sesión|registrarse|buscar|siguiente|anterior|volver arriba|leer más|ver más|compartir|imprimir|"
    r"contáctenos|sobre nosotros|quiénes somos|ir al contenido|mapa del sitio|aviso legal|índice"
)
NAV_LINE = rf"^[{SPACE}]*({NAV_ENTRIES})[{SPACE}]*$"
BOILERPLATE = (
    r"(enable javascript|javascript is (disabled|required)|accept (all )?cookies|cookie (policy|settings|preferences)|"
    r"we use cookies|lorem ipsum|terms of (use|service)|privacy policy|subscribe to our newsletter|click here to|"
    r"follow us on|share this (page|article)|all rights reserved|"
    r"alle rechte vorbehalten|datenschutzerklärung|wir verwenden cookies|cookie-einstellungen|nutzungsbedingungen|"
    r"newsletter abonnieren|klicken sie hier|folgen sie uns|bitte javascript|"
    r"tous droits réservés|politique de confidentialité|nous utilisons des cookies|accepter (tous )?les cookies|"
    r"conditions (d.utilisation|générales)|abonnez-vous à notre|cliquez ici|suivez-nous|activer javascript|"
    r"todos los derechos reservados|política de privacidad|(usamos|utilizamos) cookies|aceptar (todas )?las cookies|"
    r"términos (de uso|y condiciones)|condiciones de uso|suscríbete a nuestr|haz clic aquí|haga clic aquí|síguenos en|activar javascript)"
)
#: Each boilerplate phrase holds one of these; a text without any has none.
BOILERPLATE_SIGNS = (
    "javascript", "cookie", "lorem ipsum", "terms of", "privacy policy", "subscribe to", "click here", "follow us", "share this",
    "reserved", "vorbehalten", "datenschutz", "nutzungsbedingungen", "newsletter abo", "klicken sie", "folgen sie", "droits r",
    "confidentialit", "conditions", "abonnez", "cliquez ici", "suivez-nous", "privacidad", "términos", "condiciones de",
    "suscríbete", "clic aqu", "síguenos",
)

#: A boilerplate phrase fails a line of at most this many characters; a longer one is text that mentions it.
BOILERPLATE_CHARS = 200
#: Sentence ends of other scripts, which need nothing after them (Arabic, Urdu, Indic, Armenian, Ethiopic, Khmer, Burmese, Tibetan, CJK).
OTHER_ENDS = "[؟۔।॥։።፧፨។៕၊။།༎᙮᠃᠉꓿꘎꛳꩝꯫｡．‼⁇⁈⁉。！？]"
#: The start of a line into which the sentence of the line before runs on: a letter that is not upper case.
RUNS_ON = rf"""^[{SPACE}"'(«“]*[\p{{Ll}}\p{{Lo}}]"""


def _any(text: Column, signs) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in signs))


def line_fails(line: Column, following: Column, symbols: Column, menu: Column, boilerplate: Column) -> Column:
    """True for a line that breaks one of the line rules; ``following`` is the next line or null. The
    last three say whether the text holds symbols, menu marks and signs of boilerplate at all."""
    low = F.lower(line)
    dense = F.regexp_replace(line, f"[{SPACE}]+", "")
    n_symbols = F.length(line) - F.length(F.regexp_replace(line, LINE_SYMBOL_SET, ""))
    many = symbols & line.rlike(LINE_SYMBOL_SET) & (100 * n_symbols > MAX_LINE_SYMBOLS * F.length(dense))
    ended = line.endswith(".") | line.endswith("!") | line.endswith("?")
    open_ = ~ended & line.rlike(LONG_LINE) & ~line.rlike(CLOSED) & ~line.rlike(OTHER_ENDS) & ~F.coalesce(following.rlike(RUNS_ON), F.lit(False))
    listed = (F.length(line) <= NAV_CHARS) & low.rlike(NAV_LINE)
    return many | open_ | (menu & line.rlike(MENU)) | listed | (boilerplate & (F.length(line) <= BOILERPLATE_CHARS) & low.rlike(BOILERPLATE))


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars", "cleaned")


def clean(df: DataFrame, text: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """``df`` with the base counts, the verdict ``kept`` and the ``cleaned`` text."""
    taken = {c.lower() for c in df.columns} & set(OUTPUTS)
    if taken:
        raise ValueError(f"output columns already exist: {sorted(taken)}")
    # beside the row as a whole there are only names of this function, so none can clash
    step = df.select(F.struct(*(column(c) for c in df.columns)).alias("row"), F.coalesce(column(text), F.lit("")).alias("t"))
    step = step.select(
        "row",
        F.array_remove(F.split("t", f"[{SPACE}]+"), "").alias("words"),
        F.split("t", "\n").alias("lines"),
        F.length("t").alias("n_chars"),
        F.when(_any(F.col("t"), SYMBOLS), F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).otherwise(0).cast("long").alias("n_symbols"),
        _any(F.col("t"), SYMBOLS + "{}~^\\").alias("symbols"),
        _any(F.col("t"), "|»›•·").alias("menu"),
        _any(F.lower("t"), BOILERPLATE_SIGNS).alias("boilerplate"),
    )
    n_lines = F.size("lines")
    full = F.filter("lines", lambda x: x.rlike(f"[^{SPACE}]"))
    step = fence(step).select(
        "row",
        "n_symbols",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(F.size(F.array_distinct("lines")) < n_lines, F.size(full) - F.size(F.array_distinct(full))).otherwise(0).cast("long").alias("n_dup_lines"),
        n_lines.alias("n_lines"),
        (F.col("n_chars") - n_lines + 1).alias("all_chars"),
        F.filter("lines", lambda x, i: ~line_fails(x, F.get("lines", i + 1), F.col("symbols"), F.col("menu"), F.col("boilerplate"))).alias("good"),
        F.expr(
            "CASE WHEN size(words) >= 5 THEN transform(sequence(0, size(words) - 5),"
            " i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])) ELSE array() END"
        ).alias("grams"),
    )
    step = fence(step).withColumn("sorted", F.expr("CASE WHEN size(array_distinct(grams)) < size(grams) THEN sort_array(transform(grams, (g, i) -> struct(g AS g, i AS i))) END"))
    twice = "filter({0}, (x, k) -> coalesce(get({0}, k - 1).{1} = x.{1}, false) OR coalesce(get({0}, k + 1).{1} = x.{1}, false))"
    step = fence(step).withColumn("same", F.expr(f"sort_array(transform({twice.format('sorted', 'g')}, x -> struct(array_join(slice(words, x.i + 1, 5), ' ') AS w, x.i AS i)))"))
    step = fence(step.drop("sorted", "grams")).withColumn("at", F.expr(f"sort_array(transform({twice.format('same', 'w')}, x -> x.i))"))
    covered = F.expr("aggregate(at, struct(-5 AS prev, 0L AS n), (a, p) -> struct(p AS prev, a.n + least(5, p - a.prev) AS n), a -> a.n)")
    step = step.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.col("n_lines") - F.size("good")).cast("long").alias("n_lines_removed"),
        (F.col("all_chars") - F.length(F.array_join("good", ""))).cast("long").alias("lost_chars"),
        "all_chars",
        F.array_join("good", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    step = step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost * F.col("all_chars")))
    return fence(step).select("row.*", *OUTPUTS)


def oracle(table: str = "documents") -> str:
    """The same verdicts as DuckDB SQL."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    dense = f"regexp_replace(l, '[{SPACE}]+', '', 'g')"
    fails = f"""(length({dense}) > 0 AND (
        100 * (length({dense}) - length(regexp_replace({dense}, {q(LINE_SYMBOL_SET)}, '', 'g'))) > {MAX_LINE_SYMBOLS} * length({dense})
        OR (regexp_matches(l, {q(LONG_LINE)}) AND NOT regexp_matches(l, {q(CLOSED)}) AND NOT regexp_matches(l, {q(OTHER_ENDS)}) AND NOT regexp_matches(coalesce(nl, ''), {q(RUNS_ON)}))
        OR regexp_matches(l, {q(MENU)}) OR (length(l) <= {NAV_CHARS} AND regexp_matches(lower(l), {q(NAV_LINE)}))
        OR (length(l) <= {BOILERPLATE_CHARS} AND regexp_matches(lower(l), {q(BOILERPLATE)}))))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY r),
ln AS (SELECT r, l, {fails} AS bad, regexp_matches(l, '[^{SPACE}]') AS has FROM (SELECT r, ls[i] AS l, ls[i + 1] AS nl FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM w))),
la AS (SELECT r, count(*) FILTER (has) - count(DISTINCT l) FILTER (has) AS dl, count(*) FILTER (bad) AS removed,
  coalesce(sum(length(l)) FILTER (bad), 0) AS lost, sum(length(l)) AS total FROM ln GROUP BY r),
s AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, dl, coalesce(rep.n, 0) AS rw, removed, lost, total
  FROM w JOIN la USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(dl AS BIGINT) AS n_dup_lines, CAST(rw AS BIGINT) AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * rw > {MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * rw > {MAX_REPEATED} * n_words) AND NOT (100 * lost > {MAX_LOST} * total) AS kept,
  CAST(removed AS BIGINT) AS n_lines_removed, CAST(lost AS BIGINT) AS lost_chars
FROM s"""
