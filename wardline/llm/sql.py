"""SQL of DuckDB for the operators of this subpackage that it can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The 256 steps of the reflected CRC-32, one for each byte.
_STEPS = "(SELECT list(list_reduce([i] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS steps FROM range(256) r(i))"


def _crc(table: str, column: str = "s") -> str:
    """(s, crc) of the strings of a table, its column h being their bytes in hex."""
    bytes_ = "list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)"
    return f"SELECT {column}, xor(list_reduce([4294967295] || {bytes_}, lambda a, v: xor(a // 256, steps[xor(a % 256, v) + 1])), 4294967295) AS crc FROM (SELECT {column}, hex(encode({column})) AS h FROM {table}), {_STEPS}"


#: Words of one length that are equal without the letter at one place, and words that are others without a letter.
SPELLING_VARIANTS = f"""WITH RECURSIVE runs AS (SELECT coalesce(cast(doc_id AS VARCHAR), '') AS doc, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
 keys AS (SELECT DISTINCT doc || ':' || run AS s FROM runs), sums AS ({_crc('keys')}),
 said AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM runs JOIN sums ON s = doc || ':' || run),
 v AS (SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
 cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
 less AS (SELECT DISTINCT cut.word, v.word AS other FROM cut JOIN v ON v.word = cut.rest),
 near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT word, other FROM less UNION SELECT other, word FROM less),
 best AS (SELECT near.word, count(*) AS n_near, min({{'less': -v.n, 'form': v.word}}) AS b FROM near JOIN v ON v.word = near.other GROUP BY near.word),
 forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * v.n THEN b.form END AS form, CASE WHEN -b.less >= 10 * v.n THEN -b.less END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
 chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL)
 SELECT forms.word, forms.form, chain.at AS root, forms.n, forms.n_near, forms.form_n FROM forms JOIN chain ON chain.word = forms.word JOIN forms last ON last.word = chain.at AND last.form IS NULL"""

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WINDOWS = "flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))))"
IMPORTANCE_RESAMPLING = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
 df AS (SELECT rid, s, count(*) AS n FROM (SELECT rid, unnest({_WINDOWS}) AS s FROM d) GROUP BY rid, s), bf AS (SELECT s, count(*) AS n FROM (SELECT unnest({_WINDOWS}) AS s FROM b) GROUP BY s),
 each AS (SELECT s FROM df UNION SELECT s FROM bf), sums AS ({_crc('each')}),
 sb AS (SELECT crc % 10000 AS bucket, sum(n)::DOUBLE AS s FROM df JOIN sums USING (s) GROUP BY 1), tb AS (SELECT crc % 10000 AS bucket, sum(n)::DOUBLE AS t FROM bf JOIN sums USING (s) GROUP BY 1),
 whole AS (SELECT (SELECT coalesce(sum(s), 0) FROM sb) AS ss, (SELECT coalesce(sum(t), 0) FROM tb) AS tt),
 gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000))))::BIGINT AS gain FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN sb USING (bucket) LEFT JOIN tb USING (bucket), whole),
 weights AS (SELECT rid, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM df JOIN sums USING (s) JOIN gain ON gain.bucket = crc % 10000 GROUP BY rid),
 scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('42:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weights USING (rid)),
 placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS most FROM scored WHERE n_words >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM placed UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20"""
