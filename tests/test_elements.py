"""The tags that the structure of a page is made of."""

from pagemill.operators.elements import elements


def test_only_tags_that_matter_reach_the_windows(spark):
    html = "<body><div class=post><p>a<br>b</p><p><b><i>c</i></b></p><ul><li>d</li></ul><a href=/x>x</a></div></body>"
    ending = html.replace("<li>", "<li class=menu>").replace("</li>", "<li>e</li>")
    pages = spark.createDataFrame([(1, html), (2, ending)], "page_id long, html string")

    def found(anchors):
        rows = elements(pages, anchors=anchors).orderBy("page_id", "start").collect()
        return [[(r.tag, r.start, r.end) for r in rows if r.page_id == n] for n in (1, 2)]

    assert found(False)[0] == [("body", 0, 23), ("div", 1, 22)]
    assert found(True)[0] == [("body", 0, 23), ("div", 1, 22), ("a", 19, 21)]
    # An item to be removed ends at the next one, so items stay.
    assert ("li", 15, 16) in found(False)[1] and ("li", 17, 19) in found(False)[1]


def test_a_pair_without_tags_inside_does_not_part_the_pair_around_it(spark):
    html = "<body><nav><nav>n</nav>m</nav><div>a<div/>b</div><div><div></div></div><nav>k<div/>o</nav></body>"
    rows = elements(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    spans = {(r.tag, r.start, r.end) for r in rows}
    assert {("nav", 1, 6), ("nav", 2, 4), ("body", 0, 21)} <= spans
