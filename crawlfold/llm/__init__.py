"""Operators for large training corpora (dedup, search, packing, archives,
mixing, scoring, formatting, token counts, fingerprints). Nothing outside this
package imports it; ``registry`` lists the queries of the driver contract."""
