"""The URL model against names it was not trained on, its corpus words, and what judged urls teach it."""

from tests.llm import brute
from veilspark.llm import url_filter
from veilspark.llm.url_filter import Model, corpus_words, judge_urls, learn

BAD = (
    "casino-win free-bets ads-track spam-farm cheap-pills adult-x luckycasino spinpalacecasino bigjackpots xxxgirls freepornclips hotsexvideos cheapcialis viagraonline paydayloanstoday quickcashloan warezcrack keygendownload bestpokerbonus betwinner nudecamgirls replicawatchshop "
    "fakeidstore getrichfast adclicktracker popupbanners spamlinks malwareloader torrentkeygen dietpillsshop sexdating escortgirls livecasino slotgames buybacklinks lottowin phishinglogin hackaccounts moneyfast"
).split()
GOOD = (
    "cheapflights camberwell cityhospital openstreetmap musicteacher farmersmarket trackrecord wintergarden freelibrary coffeehouse bookclub sussexcollege essexlibrary newcastleherald dailyscience weatherchannel codeschool musicfestival historychannel doctorsoffice hotelguide trainstation healthyrecipes "
    "gardencenter lawschool artgallery radiostation videolessons onlinebank studenthousing fishingclub worldatlas springfield middlesex scunthorpe bettertomorrow expertsexchange therapistfinder penisland adventuretravel"
).split()
KNOWN = {n.replace(" ", "") for n in (*url_filter.UNWANTED, *url_filter.ORDINARY)}


def test_names_held_out():
    model = Model()
    bad, good = ([n for n in names if n.replace("-", "") not in KNOWN] for names in (BAD, GOOD))
    caught, kept = sum(model.score(f"www.{n}.com", "/en/1.html") > 0 for n in bad), sum(model.score(f"{n}.org", "/") <= 0 for n in good)
    assert (len(bad), len(good)) >= (34, 36)
    assert caught / len(bad) >= 0.85 and kept / len(good) >= 0.97, (caught, len(bad), kept, len(good))
    assert not any(n.replace("-", "") in KNOWN for n in BAD[:6])


def test_a_word_beside_letters_that_none_explains_counts_less():
    model = Model()
    assert model.words("camberwell.co", "") == ["cam", "berwell", "co"] and model.score("camberwell.co", "") < 0 < model.score("camgirls.co", "")


def test_corpus_words_help_to_cut(spark):
    texts = ["<p class=x>The Berwell road</p><script>var nothing</script>", "berwell and the road, the end", None, "", "a é théb 12x"] * 3
    pages = brute.table(spark, [(i, t, 1) for i, t in enumerate(texts)], "page_id long, html string, n long")
    words = corpus_words(pages, "html", markup=True)
    assert words == {"the": 6, "berwell": 6, "road": 6, "and": 3, "end": 3}
    assert "berwell" in Model(corpus=words).segment("theberwellroad") and Model(corpus=words).segment("theberwellroad") == ["the", "berwell", "road"]
    assert corpus_words(pages.limit(0), "html") == {}


def test_judged_urls_teach(spark):
    rows = [(f"http://zorqix{k}.com/flum/{i}", 1) for k in range(6) for i in range(50)] + [(f"https://quiet-{k}.org/park/", 0) for k in range(6)] + [(None, 1), ("no url", 1), ("http://x.y/", None)]
    urls = brute.table(spark, [(*r, "a", "b") for r in rows], "url string, unwanted int, host string, path string")
    before = Model()
    after = learn(urls, before)
    assert before.score("zorqix.net", "/flum") < 0 < after.score("zorqix.net", "/flum") and after.score("quiet.net", "/park") < before.score("quiet.net", "/park")
    assert after.odds["zorqix"] == learn(urls.filter("url not like '%/flum/7%'"), before).odds["zorqix"]  # hosts count once
    pages = brute.table(spark, [(1, "http://zorqix.info/flum")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(pages, model=after).collect()] == ["block"]
