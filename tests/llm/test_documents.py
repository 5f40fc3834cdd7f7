"""Leaks, mixing and residue against brute force and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import leaks, mixing, residue

DOCS = "doc_id bigint, text string, source string, length int, key bigint"
ITEMS = "item_id bigint, text string, id bigint"


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["monday", "12", "kg", "ಮಂಗಳವಾರ", "ﬁne", "zero‌join"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([1, 5, 12, 13, 30])))) for k in range(40)] + [(98, None), (99, " .,")]
    docs = []
    for k in range(120):
        w = say(rng.randint(0, 40))
        if k % 2:
            _, t = rng.choice(items[:40])
            own = t.split()
            w[len(w) // 2 : len(w) // 2] = own[: rng.choice([len(own), max(1, len(own) - 1), 13])]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w).upper() if k % 3 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "w1 " * 20_000)]
    return items, docs


def brute(items, docs):
    out = set()
    for i, t in items:
        w = leaks.words(t or "")
        n = min(13, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, u in docs:
            v = leaks.words(u or "")
            if windows & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}:
                out.add((i, d))
    return out


@pytest.mark.parametrize("bits", [leaks.MOST_BITS, 1 << 12])
def test_verbatim_leaks_equal_brute_force(spark, bits):
    items, docs = corpus()
    a = spark.createDataFrame([(i, t, 1) for i, t in items + items[:5]], ITEMS)
    b = spark.createDataFrame([(i, t, "s", 1, 1) for i, t in docs + docs[:5]], DOCS)
    got = leaks.leaks(a, b, most_bits=bits).where("verbatim > 0").collect()
    assert {(r.item_id, r.doc_id) for r in got} == brute(items, docs)


def test_reparameterised(spark):
    item = "On monday the farmer sold 12 kg of rice to 3 men in the town before noon came"
    docs = [(1, item.replace("12", "75").replace("monday", "friday")), (2, item.replace("12", "3")), (3, item.replace("rice", "corn"))]
    a, b = spark.createDataFrame([(7, item, 1)], ITEMS), spark.createDataFrame([(i, t, "s", 1, 1) for i, t in docs], DOCS)
    got = {r.doc_id: (r.verbatim > 0, r.reparameterised > 0) for r in leaks.leaks(a, b).collect()}
    assert got[1] == (False, True)  # other values, one for one
    assert 2 not in got or not got[2][0]
    assert 3 not in got  # another word that is no slot
    assert leaks.leaks(a.limit(0), b).count() == 0 and leaks.leaks(a, b.limit(0)).count() == 0


def test_reparameterised_with_names_of_no_list(spark):
    part = "one morning before the market opened, {} walked with {} from {} to the next village and sold {} baskets of fruit"
    given = [("Ravindra", "Shankari", "Uttanur", 12), ("Manohar", "Leelavati", "Belagere", 70), ("Manohar", "Manohar", "Belagere", 70), ("the man", "Leelavati", "Belagere", 70)]
    docs = [(k, "Years ago, " + part.format(*g)) for k, g in enumerate(given[1:], 1)] + [(9, "for a week Manohar met, Leelavati said, with Ravindra and, Shankari thought, near Belagere or near Uttanur")]
    a, b = spark.createDataFrame([(7, "Years ago, " + part.format(*given[0]), 1)], ITEMS), spark.createDataFrame([(i, t, "s", 1, 1) for i, t in docs], DOCS)
    got = {r.doc_id: (r.verbatim, r.reparameterised) for r in leaks.leaks(a, b).collect()}
    assert set(got) == {1, 2, 3} and all(v == 0 for v, _ in got.values())
    assert got[1][1] > max(got[2][1], got[3][1])  # windows with one name for two, or with a word that is none, are no leaks
    assert {r.word for r in leaks.learnt_names(a, b).collect()} >= {"ravindra", "leelavati", "belagere"}


def test_rows_of_numbers_go_by_themselves(spark):
    items = [(1, "7"), (2, " ".join(map(str, range(13)))), (3, "5 kg")]
    docs = [(k, f"{k} {k + 1} {k + 2}") for k in range(40)] + [(90, " ".join(map(str, range(20)))), (91, " ".join(map(str, range(100, 130)))), (92, "about 5 kg"), (93, "about 6 kg")]
    a, b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS), spark.createDataFrame([(i, t, "s", 1, 1) for i, t in docs], DOCS)
    m = leaks.matches(a, b)
    assert m.where("not verbatim").count() == 0
    assert {(r.item_id, r.doc_id) for r in m.collect()} == brute(items, docs)


def test_windows_of_one_template_are_kept_apart(spark):
    part = "in question {} the class counts each of the old coins by hand again "
    item = "".join(part.format(n) for n in (3, 4, 5, 6, 7))
    docs = [(n, part.format(n) + "tail") for n in (3, 4, 5, 6, 7, 8)]
    a, b = spark.createDataFrame([(7, item, 1)] * 2, ITEMS), spark.createDataFrame([(i, t, "s", 1, 1) for i, t in docs], DOCS)
    got = leaks.leaks(a, b).collect()
    assert {r.doc_id for r in got if r.verbatim} == {d for _, d in brute([(7, item)], docs)} == {3, 4, 5, 6, 7}
    assert all((r.verbatim, r.reparameterised) == ((2, 0) if r.doc_id != 8 else (0, 2)) for r in got)  # 14 words are two windows; each counts once


def test_slots_depend_on_the_word():
    assert [leaks.slot(w) for w in ("12", "೧೨", "ten", "kg", "monday", "ರಾಮನಗರದಲ್ಲಿ", "farmer")] == [1, 1, 1, 2, 3, 3, 0]
    assert leaks.words("ﬁne ＡＢ‌c!") == ["fine", "abc"]


TARGETS = "source string, target_share double, max_repeats int"


def mixture(spark, seed=1):
    rng = random.Random(seed)
    sizes = {"a": 300, "b": 80, "c": 6, "d": 0}
    rows = [(k, "x" * rng.randint(0, 200) + s + str(k), f" {s.upper()} ", 1, 1) for s, n in sizes.items() for k in range(n)]
    rows += rows[::4] + [(9001, None, "a", 1, 1), (9002, "zzz", None, 1, 1), (9003, "zzz", "other", 1, 1)]
    return rows, spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.15, 4), ("d", 0.05, 1)], TARGETS)


def test_shortfalls_are_exact(spark):
    rows, docs, targets = mixture(spark)
    size = {s: sum(len(t) for t in {t for _, t, u, *_ in rows if t is not None and u and u.strip().lower() == s}) for s in "abcd"}
    want = {r.source for r in targets.collect() if size[r.source] * r.max_repeats < r.target_share * sum(size.values())}
    assert {r.source for r in mixing.shortfalls(docs, targets).collect()} == want and "c" in want and "d" in want


def test_rates_meet_the_targets(spark):
    rows, docs, targets = mixture(spark)
    texts, duals = mixing.solution(docs, targets)
    got = texts.join(duals.drop("size"), "source").withColumn("rate", F.least(F.exp(F.col("dual") * F.col("size") / F.col("mean")), F.col("max_repeats").cast("double")))
    for r in got.where("not short").groupBy("source").agg(F.sum(F.col("size") * F.col("rate")).alias("t"), F.max("target").alias("want")).collect():
        assert abs(r.t - r.want) <= 1e-6 * r.want
    for r in mixing.mix(docs, targets).join(targets, "source").collect():
        assert 0 < r.copies <= r.max_repeats and abs(r.copies - r.rate) < 1 + 1e-9
    shares = {r.source: r for r in mixing.shares(docs, targets).collect()}
    assert abs(shares["a"].tokens / shares["b"].tokens - 0.5 / 0.3) < 0.1 and shares["d"].tokens == 0


def test_mix_of_nothing(spark):
    _, docs, targets = mixture(spark)
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


CASES = {
    "placeholder": ["Dear {{name}}, hello", "Sent to ${email|default} now", "by <%= author %> today", "on {% date %}", "see %title%.", "%%CITY%% report", "%(name)s begins", "__AUTHOR__ said", "@@phone@@!", "~URL~ is", "<<city>> and", "[[url]] x", "[#PRICE#]", "on [DATE] by", "[insert name here]", "[Your Phone Here]", "[title to be added]", "[ಇಲ್ಲಿ ಬರೆಯಿರಿ]", "(ಇಲ್ಲಿ ಸೇರಿಸಿ)", "(CITY GOES HERE)", "<enter amount> is", "TODO: add year now", "on XX/XX/XXXX we", "Sent to undefined on", "Dear [object Object], hi", "ದಿನ: [ದಿನಾಂಕ]", "#{order_no} of", "{$city} ಅವರೇ", "&lt;%= item %&gt; is", "<?= $date ?> x", "Hello {first_name}!", "by <ಹೆಸರು>."],
    "filler": ["Lorem ipsum dolor amet magna velit tempor aliqua justo mauris.", "Sample text. Sample text. Sample text.", "blah blah asdf qwerty foo bar xxx xxxx asdf", "Type something", "ಮಾದರಿ ಪಠ್ಯ. ಮಾದರಿ ಪಠ್ಯ."],
    "error": ["404 Not Found\nThe page you asked for could not be found.", "A headline of five words\nPlease enable JavaScript in your browser to view this page.", "Verify that you are not a robot.", "Traceback (most recent call last): File \"a.py\", line 3, in f KeyError: 'x'", "ಪುಟ ಸಿಗಲಿಲ್ಲ\nನೀವು ಹುಡುಕಿದ ಪುಟ ಇಲ್ಲಿ ಇಲ್ಲ.", "ಈ ಪುಟ ನೋಡಲು ಜಾವಾಸ್ಕ್ರಿಪ್ಟ್ ಸಕ್ರಿಯಗೊಳಿಸಿ."],
    None: ["the mark `{{name}}` is filled by the loader", "```\nprint(f\"{name} of {n}\")\n```", "Let S = {x : x > 9} and T = {x, y} [22].", "The <PAD> and <BOS> ids take no part", "[ಚಪ್ಪಾಳೆ] ಎಂದು 19 ಬಾರಿ [ಸಂಗೀತ].", "keeps 100% of the email_column and 5% more", "an _old_ and **bold** word", "A printer once filled sheets with a lorem ipsum, says the reader.", "Of 600 links the crawler met, some gave a 404 and were dropped.", "If a page says 'page not found', the editor writes the date beside it.", "Before JavaScript was enabled in the crawler, 85 pages came back empty.", "With 503 answers the lane waits 68 seconds; with 500 it stops at once.", "", None],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, v in CASES.items() for t in v])
def test_residue_cases(kind, text):
    assert residue.judge(text) == kind


# Wordings written apart from any table.
RESIDUE = [
    'Hello {recipient}, welcome to the spring issue.',
    'Dear <recipient>, your parcel has left the depot.',
    'Dear [Recipient Name], we write about your order.',
    'Hi {{ user.firstName }}, thanks for joining us last week.',
    'Your invoice ${invoice.total} is due on {{due_date | format}}.',
    'Good morning [FIRST_NAME], your table is ready.',
    'The meeting of [INSERT DATE HERE] was moved.',
    '[Company Name Here] is proud to announce a new office.',
    'Posted on {{post_date}} by the desk.',
    'Next bus leaves at %(departure_time)s from the square.',
    'Today in <%= city_name %>: light rain.',
    'The winner is undefined and the prize will be sent.',
    '{% if user %} Welcome back {% endif %} to the archive.',
    'Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.',
    'Add your description here. Add your description here.',
    'Insert text here',
    'asdf asdf asdf asdf asdf asdf asdf asdf asdf asdf asdf asdf',
    '500 Internal Server Error',
    'The server encountered an internal error and was unable to complete your request.',
    'Home\nNews\nSport\nWeather\n404 - Page not found\nSorry, the page you are looking for does not exist.',
    'Home | News | Sport | Weather | Business | Culture | Travel | Contact us | About | Privacy policy | Terms | Cookies | Help | Sitemap | Jobs | Subscribe | Login | Register | Blog | Shop | Events | Video | Photos | Opinion | World | Politics | Health\nError 404\nPage not found',
    'Please enable JavaScript to continue using this application.',
    'JavaScript is disabled in your browser. Please enable it and reload the page.',
    'Checking your browser before accessing the site. This process is automatic.',
    "Access denied. You don't have permission to access this resource.",
    "Warning: mysqli_connect(): Access denied for user 'root'@'localhost' in /var/www/db.php on line 12",
    'Fatal error: Uncaught Error: Call to undefined function get_header() in /var/www/html/index.php:3',
    '503 Service Temporarily Unavailable\nnginx/1.18.0',
    "TypeError: Cannot read properties of undefined (reading 'title')",
    'ಪ್ರಿಯ {ಗ್ರಾಹಕ} ಅವರೇ, ನಿಮ್ಮ ಪತ್ರ ತಲುಪಿದೆ.',
    'Thank you {customer_name} for your letter.',
    'Signed, [Your Name], secretary of the club.',
    'Call us at [PHONE NUMBER] any day.',
    'The total comes to $[AMOUNT] with tax.',
    'Our address is <Your Address>, second floor.',
    '@@@COMPANY@@@ has its office on the hill.',
    'Attention required! One more step: please complete the security check to access.',
    'This video is no longer available.',
    'We could not load this page. Try again later.',
    'An error occurred while processing your request. Reference #18.2f3a.',
]
SPOKEN_ABOUT = [
    'A long article with [[Bengaluru]] links, and [[Mysuru]] beside it, and [[Hampi]] far away.',
    'In C++ the stream is written with a <<b>> c in code prose.',
    'In a template, {{name}} is replaced by the value of the variable before the page is sent.',
    'Use {{name}} to print a variable and {% if %} to start a condition.',
    'The placeholder ${user} stands for the account that runs the job.',
    'Editors type [DATE] where the day of issue goes, and the press fills it in.',
    'The mark "[TBD]" shows that a day has not been set.',
    'The set {name, age, city} has three fields.',
    'For all x in {a, b} the sum holds [see note 4].',
    'A 404 means that a page is not there; our crawler drops such pages and writes the address to a log.',
    'He wrote "lorem ipsum" on the wall and walked away.',
    'The tokens <pad>, <s> and </s> are added by the tokenizer.',
    'If the value is null the row is dropped, and NaN is written as an empty cell.',
    'The traceback pointed at line 3, so the team mended the reader and ran it again.',
    '[laughs] No, we never had a printer at the school. [applause]',
    'The regex \\\\{[a-z]+\\\\} finds single braces.',
    'An error occurred in the third night of the run, and the ledger showed which step had to be done again before the morning meeting could begin.',
    'f(x) = {x if x > 0 else 0} is the rectifier.',
    'The symbols [CLS] and [SEP] mark the ends of the sequence.',
    'Dear readers, we thank you <3 for all the letters.',
    'The key <Enter> ends the line and <Tab> moves on.',
    'The page (to be continued) ends with a poem.',
    'Mail merge uses «name» as a field for each letter.',
    'Our house style writes XX/XX for unknown days, which we do not print.',
]


@pytest.mark.parametrize("text", RESIDUE)
def test_wordings_of_residue(text):
    assert residue.judge(text)
    assert residue.judge("A headline\n" + text)


@pytest.mark.parametrize("text", SPOKEN_ABOUT)
def test_wordings_that_speak_about_it(text):
    assert residue.judge(text) is None


def test_content_with_a_notice_in_it_stays():
    content = "The river was high that year and the school closed early. " * 12
    assert residue.judge(content + "Please enable JavaScript in your browser to view this page.") is None
    assert residue.judge(content + "Dear {{name}}, hello.") == "placeholder"


@pytest.mark.parametrize("n", [1, 10, 100, 2000])
def test_long_program_output(n):
    python = "Traceback (most recent call last):\n" + "".join(f'  File "/srv/app/stage_{k}.py", line {k}, in step_{k}\n    value = reader.next_batch(source, size_{k})\n            ~~~~~~~~~~~~~~~~~^^^^^^^^^\n' for k in range(n)) + "KeyError: 'lane'\n"
    bare = "Traceback (most recent call last):\n" + "".join(f'  File "stage.py", line {k}, in step\n' for k in range(n)) + "ValueError: no lane"
    flat = "Traceback (most recent call last): " + "".join(f'File "stage.py", line {k}, in step value = reader.next(source, {k}) ' for k in range(n)) + "ValueError: no lane"
    frames = "".join(f"\n        at org.app.Stage$Inner.step{k}(Stage.java:{k})" for k in range(n))
    java = f'Exception in thread "main" java.lang.IllegalStateException: no lane{frames}\nCaused by: java.io.IOException: closed{frames}\n        ... {n} more'
    for text in (python, bare, flat, java, "Morning news\n" + python):
        assert residue.judge(text) == "error"
        assert residue.judge(text + "The river was high that year and the school closed early. " * 12) is None
    assert residue.judge("The river was high that year and the school closed early. " * 12 + java) is None


@pytest.mark.parametrize("words", ["blah", "xxx", "test", "foo bar", "lorem ipsum", "qux", "test, bar,", "sed et", "zzz\n"])
def test_runs_of_one_or_two_filler_words(words):
    few = " ".join([words] * (12 // len(words.split())))
    assert residue.judge(few) == residue.judge("A headline\n" + f"{few} " * 20) == "filler"
    assert residue.judge("He said " + " ".join(few.split()[:11]) + " and left.") is None


def test_a_long_menu_is_no_content():
    menu = "Home | News | Sport | Weather | Business | Culture | Travel | World | Politics | Health\n" * 20
    assert residue.judge(menu + "404 Not Found\nThe page you asked for could not be found.") == "error"
    assert residue.judge("apple | pear | plum | fig | grape | quince | peach | cherry | date | lime\n" * 20 + "404 Not Found") is None


def test_a_tutorial_with_marks_of_its_own():
    tutorial = "In a template, {{name}} is replaced by the value. Write {{city}} for the town. "
    assert residue.judge(tutorial * 30 + "Here {{town}} comes out too.") is None
    assert residue.judge("The river was high. " * 50 + "Our desk at {{town}} wrote this. " + "The school closed early. " * 50) == "placeholder"


def test_blank_lines_are_no_words():
    assert residue.judge("404 Not Found" + "\n   " * 500 + "The page you asked for could not be found.") == "error"


def test_residue_table(spark):
    rows = [(k, t, "s", 1, 1) for k, t in enumerate(["Dear {{name}}", "fine text", None, "", "x " * 100_000])] + [(0, "Dear {{name}}", "s", 1, 1), (None, "Dear {{name}}", "s", 1, 1)]
    df = spark.createDataFrame(rows, DOCS)
    assert [(r.doc_id, r.residue) for r in residue.residue(df).collect()] == [(0, "placeholder")]
    assert residue.without_residue(df).count() == 5
    assert residue.residue(df.limit(0)).count() == 0
