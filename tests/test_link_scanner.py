"""Links after markup that is no HTML."""

import random

from crawlfold.operators.links import scoped_links


def test_links_after_odd_markup(spark):
    rng = random.Random(1)
    pieces = ["<![", "<!", "[", "foo", "cdata", "if", "]>", "]]>", '<a href="/x">', "</a>", "<!--", "-->", "&", "<", ">", "?", " ", "<!doctype", "<?", '"']
    pages = ['..<![foo bar[ > <a href="/late">x</a>', '<![if IE]><a href="/a">q</a><![endif]><a href="/d">z</a>']
    pages += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    got = scoped_links(spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "url string, body string")).collect()
    assert [r.href for r in got if r.url == "0"] == ["/late"]
    assert [r.href for r in got if r.url == "1"] == ["/a", "/d"]
    assert {r.href for r in got if int(r.url) > 1} <= {"/x"}  # nothing raises, and nothing else is a link
