"""Titles of the portal pages whose text holds references."""
from contrapunto.operators import pages as P
from contrapunto.plans.analogs import portal_pages


class _Pages:
    def __init__(self, spark, titles):
        span = "<tr><td><label>Título:</label></td><td><span>{}</span></td></tr><tr><td><label>Número del proceso:</label></td><td>NP-1</td></tr>"
        self.paginas = spark.createDataFrame([(i, "<table>" + span.format(t) + "</table><p>&quot;</p>") for i, t in enumerate(titles)], "page_id long, html string")


def test_titles_resolve_ampersands_alone(spark):
    titles = ["a &amp; b", "cut&amp", "cut&am", "a = &quot;b", "&lt;i&gt;", "&amp;quot; &amp;amp;", "plain"]
    got = {r["page_id"]: r["valor"] for r in P.page_fields(P.parse_pages(portal_pages(_Pages(spark, titles)), "page_id", "html"), "page_id").where("etiqueta = 'Titulo'").collect()}
    assert got == {i: t.replace("&amp;", "&") for i, t in enumerate(titles)}
