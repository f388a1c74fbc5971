"""A small labelled table for the decision tree of operator 9: invented pages as markup.

A block that begins with ``¶`` is main text; ``{n}`` stands for n words.
"""

from __future__ import annotations

import re

_WORDS = "the river runs past old stone houses where people of the town keep small gardens and talk about weather boats bread or whatever the day has brought".split()

_NAV = "<nav><ul>" + "".join(f"<li><a href='/{k}'>{{1}}</a></li>" for k in range(5)) + "</ul></nav>"
_LINKS = "".join(f"<div><a href='/{k}'>{{2}}</a></div>" for k in range(4))

#: With an article or main element: everything in it but what is marked as something else.
PAGES = [
    _NAV + "<header><p>{9}</p></header><article><h1>¶{7}</h1><p>¶{60}</p><p>¶{44} <a href=x>{1}</a></p><p>¶{1}</p><p>¶{30}</p><ul><li>¶<a href=y>{3}</a><li>¶<a href=z>{2}</a></ul></article><footer>{12}</footer>",
    "<div><a href=a>{3}</a></div><div>{14}</div><main><h1>¶{2}</h1><p>¶{2}</p><p>¶{1}</p><p>¶{5}</p><p>¶{210}</p><div class='advert'><p>{35}</p></div><p>¶{88}</p></main><p>{4}</p>",
    "<div class='cookie-notice'><p>{22}</p><h2>{3}</h2></div><article><p>¶{40}</p><section class='comments'><p>{33}</p><p>{28} <a href=u>{3}</a></p><p><a href=v>{5}</a></p></section><p>¶{17}</p></article><p>{3} <a href=w>{3}</a></p><p>{44}</p><p>{61}</p><footer><p>{8}</p></footer>",
    "<div>{120}</div><article><header><h1>¶{11}</h1><p>¶{5}</p></header><p>¶{95}</p><p>¶{146} <a href=x>{4}</a></p><h2>¶{4}</h2><p>¶{5} <a href=y>{8}</a></p><p>¶{70}</p><div id=comments><h3>{2}</h3><p>{90}</p><p>{75}</p></div></article><div id=footer>{13} <a href=z>{3}</a></div>",
    "<p><a href=a>{1}</a></p><p><a href=b>{1}</a></p><div class=banner>{30}</div><article><p>¶{1}</p><p>¶{1}</p><p>¶{52}</p><blockquote>¶{8}</blockquote></article><p>{1}</p>",
    "<div class=menu><a href=a>{2}</a></div><main><p>¶{18}</p><p>¶{9}</p><p>¶{14}</p><div><p>¶{26}</p></div></main><aside><p>{65}</p></aside><form><p>{4}</p></form>",
    "<div role=banner>{5}</div><article><h2>¶{6}</h2><ol><li>¶<a href=a>{10}</a><li>¶<a href=b>{24}</a></ol><p>¶{3}</p></article><p>{10}</p><p><a href=c>{25}</a></p><article class='comment'><p>{19}</p></article>",
    "<main><h1>¶{3}</h1><p>¶{300}</p><p>¶{4}</p><aside>{80}</aside><p>¶{12}</p><p>¶{36}</p><nav><a href=n>{1}</a></nav></main><aside><p>{100}</p></aside><div>{55}</div>",
    # very short ones, link lists and single blocks are main text wherever they stand in such an element, and long prose beside it is not
    "<article><p>¶{1}</p></article>",
    "<article><p>¶{6}</p><p>¶{3}</p></article>",
    "<main><p>¶{9}</p></main><footer>{4}</footer>",
    "<article><ul><li>¶<a href=a>{2}</a><li>¶<a href=b>{3}</a><li>¶<a href=c>{1}</a></ul></article>",
    _NAV + "<article><p>¶<a href=a>{6}</a></p><p>¶{2}</p></article>" + _NAV,
    "<div>{70}</div><main><p>¶{20}</p></main><div>{90}</div><div>{33}</div>",
    "<p>{25}</p><article><h1>¶{3}</h1></article><p>{48}</p>",
    "<article><p>¶{12}</p><p>¶<a href=a>{4}</a></p></article><div>{31}</div>",
    "<article><table><tr><td>¶{1}<td>¶{2}<tr><td>¶{1}<td>¶{1}</table><p>¶{29} <a href=a>{9}</a></p></article>",
    "<header>{40}</header><main><p>¶{5} <a href=a>{5}</a></p><p>¶{4}</p></main><aside>{50}</aside><footer>{60}</footer>",
    "<main><div class=ad>{12}</div><p>¶{2}</p><div class=newsletter><p>{25}</p></div></main>",
    "<article><p>¶{66}</p><form><p>{18}</p></form><p>¶{7}</p><aside>{34}</aside></article>",
    "<div class=sidebar><p>{45}</p></div><article><p>¶{3}</p><p>¶{2}</p><p>¶{8}</p></article>",
    "<article><p>¶{27}</p></article><div class=comments><p>{41}</p><p>{7}</p></div>",
    # without one: only size, links and neighbours tell
    _LINKS + "<h1>¶{8}</h1><p>¶{55}</p><p>¶{68} <a href=x>{2}</a></p><p>¶{12}</p><p>¶{48}</p><p>{1} <a href=y>{4}</a></p><p><a href=z>{4}</a></p><p>{6}</p>",
    "<h1>¶{6}</h1><p>¶{80}</p><p>¶{95}</p><p>¶{14} <a href=x>{2}</a></p><p>¶{30}</p><p><a href=y>{2}</a></p><p>{3} <a href=z>{6}</a></p><p><a href=w>{7}</a></p>",
    _NAV + "<div class=advert><p>{40}</p></div><div class=notice>{22}</div><h1>¶{9}</h1><p>¶{64}</p><p>¶{14}</p><p>¶{75}</p><p>{3} <a href=a>{25}</a></p><p>{8} <a href=b>{12}</a></p><p><a href=c>{3}</a></p>",
    "<p><a href=a>{2}</a></p><p>{5}</p><p>{4}</p><p>{3}</p><p><a href=b>{1}</a></p><div id=comments><h3>{3}</h3><p>{33}</p></div>",
    "<p>¶{33}</p><p>¶{95} <a href=x>{5}</a></p><p>¶{60}</p>",
    "<div>¶{50}</div>",
    _LINKS + "<div>¶{41}</div><div>¶{9}</div><div>¶{77}</div>" + _LINKS + "<div>{3}</div>",
    "<div>¶{24}</div><div>¶{31}</div><div>{7} <a href=a>{18}</a></div><div><a href=b>{3}</a></div><div>{4}</div>",
    "<p>¶{38}</p><footer><p>{30}</p></footer><div class=alert>{26}</div>",
    "<div class=banner>{29}</div><p>¶{58}</p><p>¶{36}</p><aside><p>{47}</p></aside>",
    _LINKS + "<div><p>¶{24}</p><p>¶{26}</p></div><div><a href=a>{2}</a></div>",
    "<div><a href=a>{1}</a></div><div>¶{21}</div><div>¶{23}</div><div>¶{19}</div><div>{5}</div><div><a href=b>{2}</a></div>",
    _NAV + "<h1>¶{5}</h1><p>¶{20}</p><p>¶{37}</p><p>¶{22}</p><footer>{25}</footer>",
    _LINKS + "<p>¶{18}</p><p>¶{29}</p><p>¶{16}</p><p><a href=a>{3}</a></p>",
    "<header><p>{12}</p><p>{31}</p></header><h1>¶{7}</h1><p>¶{42}</p><p>¶{31}</p><footer><p>{16}</p><p>{20}</p></footer>",
    "<aside><p>{30}</p><p>{22}</p></aside><p>¶{51}</p><form><p>{9}</p><p>{24}</p></form><p>¶{26}</p><p>¶{33}</p><aside><h3>{3}</h3><p>{40}</p><p>{50}</p></aside>",
    "<aside><p>{35}</p></aside><aside><p>{44}</p></aside><div>¶{60}</div><div>¶{20}</div><footer>{45}</footer>",
    _LINKS + "<h2>¶{4}</h2><div>¶{130}</div><h2>¶{3}</h2><div>¶{28} <a href=a>{3}</a></div><div>¶{18}</div><div>¶{90}</div><div><a href=b>{1}</a></div><div><a href=c>{2}</a></div>",
]


def expand(page: str) -> str:
    at = 0

    def words(m: re.Match) -> str:
        nonlocal at
        n = int(m[1])
        at += n
        return " ".join(_WORDS[(at - n + k) % len(_WORDS)] for k in range(n))

    return re.sub(r"\{(\d+)\}", words, page)
