"""Problem 1: attribute-value rows into a wide table."""

from __future__ import annotations

from ..operators.eav import REPO_COUNTS, cells, repo_counts
from ..runtime import table


def p1_found(spark, d):
    return cells(repo_counts(table(spark, d, "semrepo_nt")), "repo", [a.field for a in REPO_COUNTS])


def p1_wide(spark, d):
    return repo_counts(table(spark, d, "semrepo_nt"))


_CELLS = r"""
WITH lit AS (
  SELECT lower(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/]+/)+?repository/([^/]+/[^/]+?)/?$', 1)) AS repo,
         CASE regexp_extract(p, '([^/#]*)$', 1) WHEN 'hasTotalStargazers' THEN 'stargazers' WHEN 'hasTotalForks' THEN 'forks'
              WHEN 'hasTotalContributor' THEN 'contributors' WHEN 'hasTotalOpenIssues' THEN 'open_issues' END AS field,
         line_no, trim(regexp_replace(regexp_replace(o, '\^\^\S*\s*$', ''), '"', '', 'g'), E' \t\n\r') AS t
  FROM semrepo_nt WHERE kind = 'literal'),
num AS (
  SELECT repo, field, line_no,
         try_cast(CASE WHEN regexp_full_match(t, '[+-]?\d{1,3}([,_'' ]\d{3})+(\.\d*)?') THEN regexp_replace(t, '[,_'' ]', '', 'g')
                       WHEN regexp_full_match(t, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,2})?') THEN t END AS decimal(38,9)) AS v
  FROM lit WHERE repo <> '' AND field IS NOT NULL),
cell AS (SELECT repo, field, CAST(arg_max(v, line_no) AS bigint) AS value FROM num WHERE v >= 0 AND v = floor(v) GROUP BY ALL)
"""

QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide}
ORACLES = {
    "p1_found": _CELLS + "SELECT repo, field, value FROM cell",
    "p1_wide": _CELLS
    + """SELECT repo, max(value) FILTER (field = 'stargazers') AS stargazers, max(value) FILTER (field = 'forks') AS forks,
         max(value) FILTER (field = 'contributors') AS contributors, max(value) FILTER (field = 'open_issues') AS open_issues
         FROM cell GROUP BY repo""",
}
