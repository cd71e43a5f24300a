from __future__ import annotations

import pytest

from loomdex.llm.moderation import Grammar, unsafe_rates, unsafe_scores

UNSAFE = [
    "You are a brainless moron and it proves it.", "> Listen, rotten halfwit: I will find out where you live and smash more than your pool.", "Sh*t happens. What a spineless piece of s*it you are, go hash your own miners.",
    "You are a br@1nl3ss cl0wn.", "Shuuut theee fuck up, you worthless imbecile, nobody asked.", "She begged him to f-u-c-k her.", "Those foreigners are vermin and must be driven\nout of this project.", "Typical, immigrants have no brain and belong in a cage.",
    "Do us all a favour and jump off a bridge before you merge again.", "Free porn cams xxx, horny singles near you.", "Tu es un imbécile pathétique.", "Du bist ein verdammter Vollidiot.", "Somebody ought to beat the crap out of the maintainer.",
]
SAFE = [
    "We have to kill the child process before the parent can reap it.", "That was a stupid mistake on my side.", "This hack is ugly as sin and I am ashamed of my own cache.", "The code of conduct forbids insults, slurs and sexual remarks.", "Dumb mode drops the queue because it is a dirty hack.",
    "Somebody was banned for insulting the sender; the log is locked.", "Make it idiot-proof so that an attacker can't.", "A naked pointer made it blow up.", "This is a damn good parser.", "Shoot me a mail if it bites you again.", "Strip the witness and expose the bare key.", "", "master and slave keys", "Get Mailwren for mobile",
]


@pytest.mark.parametrize("text", UNSAFE)
def test_unsafe(text):
    assert Grammar().score(text)[0] >= 0.5


@pytest.mark.parametrize("text", SAFE)
def test_safe(text):
    assert Grammar().score(text)[0] < 0.5


#: Sentences that no test table holds: forms by rule, peoples that do not exist.
UNSEEN_UNSAFE = [
    "All Frobnians are vermin", "You are a dolt", "you absolute nincompoop", "He is an idiot.", "The moderator is a complete moron", "The maintainers are a bunch of morons",
    "You people are idiots", "those Blorkish folk are an inferior race", "Kick out all Vendarians", "They should deport the immigrants", "I will kill you", "I'm going to break your legs",
    "I hope you die in a fire", "Go kill yourself", "you're pathetic", "You are so stupid", "What an idiot you are", "Your mother is a whore",
    "shut your fucking mouth", "fuck you and your patches", "You disgust me", "this guy is a complete asshole", "Nobody likes you, kys.", "Women are inferior",
    "gays belong in a cage", "Never trust Zorbanians", "No jobs for foreigners", "go back to your country", "she has huge tits", "I want to lick your pussy",
    "naked girls on cams", "send me your nudes, baby", "he fucked her hard", "Somebody should punch you in the face", "If you merge this I will hurt you", "You are worthless trash",
    "You fucking moron", "Listen, idiot: stop it or I find out where you live", "Jews are rats", "we should gas the refugees",
]
UNSEEN_UNSAFE += ["Eres un idiota asqueroso", "Du bist so dumm", "Me das asco.", "Ausländer raus!", "ALL FROBNIANS ARE VERMIN", "We have said it here many times before, those Frobnish\npeople are vermin and have nothing to add", "A long line of text that is wrapped here because somebody\nought to beat the crap out of him"]
UNSEEN_SAFE = [
    "You are not a stupid idiot at all.", "Nobody said you are a moron.", "Women and children live in huts near the river", "The immigrants went back to the house", "immigrants are welcome in our house", "I am an idiot, sorry",
    "what an idiot I was", "my stupid mistake", "kill the process and its children", "the master kills the slave", "He said you are an idiot and was banned", "We do not tolerate insults like 'you are a moron'",
    "This is not idiot-proof", "I never said that you are stupid", "dirty pages are flushed", "Dumb terminals are useless", "Your stupid bot is broken", "the dick pic spam was removed",
    "sex field in the form is optional", "Refugees are not vermin", "hit your endpoint", "strip the witness", "you are in trouble", "this parser is garbage",
    "these results are useless", "We should drop dead peers", "Trust no one", "Do not trust the Guardian", "They breed cats", "I will beat you to it",
    "You will find your keys", "Never let users near the database", "where do you live?", "Could you go back to the previous version", "Gays and lesbians founded the group", "black list",
    "white space is trimmed", "Blacks and whites vote", "all women are invited", "wet run of the naked build",
]


@pytest.mark.parametrize("text", UNSEEN_UNSAFE)
def test_unseen_unsafe(text):
    assert Grammar().score(text)[0] >= 0.5


@pytest.mark.parametrize("text", UNSEEN_SAFE)
def test_unseen_safe(text):
    assert Grammar().score(text)[0] < 0.5


def test_rated_sample(sf):
    """Agreement with the majority of raters on the sample at scale 0.1 (raters err)."""
    import pandas as pd

    base = sf.replace("sf0.001", "sf0.1")
    labels = pd.read_parquet(f"{base}/moderation_labels.parquet").dropna().groupby("doc_id").unsafe.mean()
    docs = pd.read_parquet(f"{base}/documents.parquet", columns=["doc_id", "text"]).set_index("doc_id").join(labels, how="inner")
    docs = docs[docs.unsafe != 0.5]
    g = Grammar()
    flag = docs.text.map(lambda t: g.score(t)[0] >= 0.5)
    assert ((docs.unsafe > 0.5) == flag).mean() > 0.93


def test_frame(spark):
    rows = [(1, UNSAFE[0], "a", 1.0), (2, None, "a", 1.0), (3, "", None, 1.0), (1, UNSAFE[0], "a", 1.0), (4, "fine words " * 50000 + ". " + UNSAFE[0], "b", 1.0)]
    scores = unsafe_scores(spark.createDataFrame(rows, "doc_id long, text string, source string, score double"))
    got = sorted((r.doc_id, r.score >= 0.5) for r in scores.collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, True)]
    rates = {r.source: (r.n_documents, r.n_unsafe) for r in unsafe_rates(scores).collect()}
    assert rates == {"a": (3, 2), None: (1, 0), "b": (1, 1)}
    assert unsafe_scores(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("text", ["I don't think you are an idiot.", "you are not a stupid idiot", "I don’t believe that you're a moron.", "I would never call you an idiot.", "You aren't a clown.", "Immigrants are not vermin.", "I will not hurt you."])
def test_denied(text):
    assert Grammar().score(text)[0] < 0.5


@pytest.mark.parametrize(
    "text",
    [
        "You are nothing but a stupid idiot.", "You are not only a stupid idiot.", "I don't think you fucking idiots can read.", "You are not helping, you stupid idiot.", "I can't wait to strangle you.", "Never trust immigrants.", "I don't think you are not a stupid idiot.",
        "You are not a liar. You are a stupid idiot.", "you are not a clown and you are a moron",
    ],
)
def test_negation_in_abuse(text):
    assert Grammar().score(text)[0] >= 0.5


@pytest.mark.parametrize("text", ["you said i called you names, you fucking idiot", "merged: policy wording\nreported by ci\nyou are a worthless moron\nbuild passed", "moderators said the banned list is long\nThose foreigners are vermin", "he said that the policy " + "was fine and " * 20 + "you are a worthless moron"])
def test_report_elsewhere(text):
    assert Grammar().score(text)[0] >= 0.5


@pytest.mark.parametrize("text", ["He was banned because he said you are an idiot.", "Moderators reported the insult: you idiot.", "the wording 'you are a moron' was reported, so the log is locked"])
def test_report(text):
    assert Grammar().score(text)[0] < 0.5
