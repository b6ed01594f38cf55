"""crawlfold: find French company identifiers (SIREN / SIRET) and contact
e-mails in saved web pages, as Spark DataFrame jobs.

Layout:
  functions/  Column -> Column building blocks (text, URLs, scores, regexes)
  sources/    readers for domain lists, page snapshots, derived inputs
  operators/  DataFrame -> DataFrame steps (links, sitemaps, crawl, ranking)
  plans/      end-to-end pipelines and reports
  streaming/  the page-level extraction over a stream of snapshots
"""

__version__ = "0.1.0"
