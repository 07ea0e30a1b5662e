import pytest

from lodestrata.llm.residue import COVER, field_name, find_residue, mark_residue

REAL = "You will plan the work of the team. We offer 404 days of leave and flexible hours."


@pytest.mark.parametrize("text,kind", [
    ("{{ job.title }}", "template"), (f"{REAL} Contact ${{recruiter.email}} now.", "template"), ("Engineer (%first_name%)", "template"), ("__ROLE_NAME__", "template"), ("Welcome to [COMPANY NAME]", "template"),
    ("Hours: «hours»", "template"), ("You report to <insert manager here>.", "template"), ("[insert team] Engineer", "template"), ("Benefits: [object Object]", "template"), ("At least NaN years", "template"),
    ("<% if x %> health <% end %>", "template"), ("Start: {start_date}", "template"), ("&lt;office_city&gt;", "template"), ("|*NAME*|", "template"), ("@@CITY@@", "template"), ("#{name}", "template"), ("We are #COMPANY_SHORT# and we care.", "template"), ("Senior {0} Editor", "template"), ("undefined - undefined", "template"), ("blah blah blah description blah (id 57f527)", "filler"),
    ("404 - page not found", "error"), ("Access denied. Reference no. 1.2", "error"), ("Seite nicht gefunden. Bitte prüfen Sie die Adresse.", "error"), ("Página no encontrada", "error"), ("503 Service Unavailable.", "error"),
    ("Bad gateway (upstream Xyz timed out)", "error"), ("You need to enable JavaScript to run this app.", "script"), ("Veuillez activer JavaScript pour afficher cette offre.", "script"), ("Loading... If nothing happens, allow scripts for this page.", "script"),
    ("Lorem ipsum dolor sit amet, consectetur elit.", "filler"), ("MAGNA ELIT SED LOREM VITAE NULLA", "filler"), (f"{REAL}\n- TODO: add responsibilities", "filler"), ("qwerty qwerty qwerty 12", "filler"), ("This is a test posting, please ignore.", "filler"),
])
def test_residue(text, kind):
    coverage, dense, kinds = find_residue(text)
    assert kind in kinds and 0 < coverage <= 1 and dense >= COVER


@pytest.mark.parametrize("text", [
    REAL, "", "   ", "Our error pages are famous: you design what people see when access is denied.", "You will reduce 404 and 503 errors on our public pages by half.", "JavaScript is required for this role, as is patience with old browsers.",
    "You replace lorem ipsum in our drafts with clear words that customers understand.", "You explain to clients how scripts and cookies are switched on in a browser.", "JavaScript Engineer [Remote]", "Candidates on short contracts [B2B] are welcome <3.",
    "You pick one of {Python, Go, Rust} for your own work.", "Pay grade: $70k-$95k (100% on site).", "Placeholder Copy Editor", "Error Page Designer", "Test Manager Bay", "Null Safety Engineer", "Template Editor", "Site Maintenance Planner", "#hiring in C#, F#", "We test, and test again, before we publish.",
    "«Bonjour», dit le chef.", "Relocation is not available for this role.", "Scheduled Maintenance Engineer", "Scheduled maintenance is planned by you and the team in the plant.", "Placeholder Copy Editor (m/f/d)", "To continue our growth we hire a planner.", "You add a title to every page of our guides.", "JavaScript required",
    "You write the error messages that people see when a page is not found.", "In your browser you will test our products each day.", "Status 200 is what our customers want from us every day.", "Sin dolor: sed y nulla no bastan.", "Join our talent pool",
])
def test_real_text(text):
    assert find_residue(text) == (0.0, 0.0, [])


@pytest.mark.parametrize("text,kind", [
    ('{{ job.url | default("' + "x" * 500 + '") }}', "template"), ("(insert location)", "template"), ("[Firmenname]", "template"), ("Hello [recipient]", "template"), ("Hi XX_COMPANY_XX team", "template"),
    ("Error 1020: this request was blocked by the security service", "error"), ("Oops! That page can't be found.", "error"), ("Bitte JavaScript im Browser erlauben", "script"), ("This content requires scripting to be on", "script"),
    ("TBC", "filler"), ("Suspendisse potenti nulla facilisi mauris", "filler"), ("Software Engineer - Lorem ipsum", "filler"), ("Software Engineer – TBD", "filler"), ("We plan each day. TODO: add responsibilities You will plan the work of the whole team", "filler"), ("Access denied The team plans the work of the whole year", "error"),
    ("Die angeforderte Seite wurde nicht gefunden.", "error"), ("Fehler 404", "error"), ("La page que vous recherchez est introuvable.", "error"), ("Serviço temporariamente indisponível", "error"), ("Er is een onverwachte fout opgetreden.", "error"), ("The server encountered an internal error and was unable to complete your request.", "error"),
    ("Questo sito richiede JavaScript.", "script"), ("You must have JavaScript enabled to view this page.", "script"), ("Voeg hier een beschrijving toe", "filler"), ("Ne pas publier", "filler"), ("XXXXXX", "filler"), ("todo: write about the benefits of working with us", "filler"), (f"{REAL} Lorem  ipsum dolor\u00a0sit amet, elit sed. {REAL}", "filler"),
])
def test_shapes_that_were_missed_once(text, kind):
    assert kind in find_residue(text)[2]


def test_field_names():
    assert all(map(field_name, ["first_name", "jobTitle", "job.location.city", "DEPARTMENT", "Candidate First Name", "insert x here"]))
    assert not any(map(field_name, ["Remote", "B2B", "Python, Go"]))


def test_table(spark):
    df = spark.createDataFrame([("a", None, None, 1), ("b", "{{t}}", "text", 2), ("b", "{{t}}", "text", 2), (None, "x", "404 - page not found", 3), ("long", "t", "word " * 60_000 + "{{x}}", 4)], "id string, title string, body string, coverage int")
    rows = sorted((str(r["id"]), r["kinds"], r["coverage"] > 0.5) for r in mark_residue(df, ["id"], ["title", "body"]).collect())
    assert rows == [("None", "error", True), ("a", "", False), ("b", "template", True), ("b", "template", True), ("long", "template", False)]
    assert mark_residue(df.limit(0), ["id"], ["title"]).count() == 0
