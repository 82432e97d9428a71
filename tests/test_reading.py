"""Reports read in runs of plain rows."""

import pytest

from tallyloom.sources import reports

HEAD = "<table class='history'><thead><tr><th>Symbol</th><th>Profit</th></tr></thead><tbody>"
PLAIN = "".join(f"<tr><td>S{i}</td><td> {i}.5 </td></tr>\n" for i in range(2500))
PAGES = [
    HEAD + PLAIN + "</tbody></table>",
    PLAIN,
    "<table>" + PLAIN + "</table>" + PLAIN,
    HEAD + "<!-- " + PLAIN + " -->" + PLAIN,
    HEAD + "<tr><td>open " + PLAIN + "<tr><td></td><td>A&amp;B</td></tr>" + PLAIN,
    HEAD + "<script>" + PLAIN + "</script>" + PLAIN,
    HEAD + '<tr><td title="' + PLAIN + '">x</td><td>1</td></tr>' + PLAIN,
    HEAD + "<tr><td>a & b" + PLAIN + "</tbody><tbody>" + PLAIN + "<tr><td><table><tr><td>in</td></tr>" + PLAIN,
    "<textarea>" + HEAD + PLAIN,
]


@pytest.mark.parametrize("page", range(len(PAGES)))
def test_runs_of_rows_are_read_as_tag_by_tag(page):
    whole, plain = reports._Tables(), reports._Tables()
    whole.feed(PAGES[page])
    plain.read(PAGES[page])
    whole.close()
    plain.close()
    assert plain.tables == whole.tables


def test_plain_rows_are_not_parsed_tag_by_tag(monkeypatch):
    seen, plain = [], reports._Tables.handle_starttag
    monkeypatch.setattr(reports._Tables, "handle_starttag", lambda self, tag, attrs: seen.append(tag) or plain(self, tag, attrs))
    assert len(reports.html_rows(PAGES[0].encode())) == 2500 and len(seen) < 20
