"""Abusive, hateful or sexual content: a weighted finite-state pattern grammar over clauses.

A text is cut into clauses and tokens. *Spelling* rewrites a token to a word of the lexicon if it is one in disguise (digits and signs for
letters, starred or hyphenated letters, stretched letters, accents), and the lexicon turns words into symbols. The symbols of a clause
then run through one composed machine (``fst.Composed``):

1. *phrases*: set phrases become one symbol ("shut the fuck up", "where you live");
2. *chunks*: noun phrases become one symbol: insults with their determiner and adjectives, groups of people by construction ("those X people", "the
   X-ish", "X-ians": no list of peoples), persons;
3. *negation*: predicates that a negation governs come out damped ("you are not a ...", "I don't think you are ..."), unless it is taken back ("not only
   ...", "nothing but ...", "can't wait to ...", a second negation);
4. *reported speech*: what somebody is said to have said, or what is talked about as a wording, comes out damped;
5. *clauses*: weighted patterns for insults, threats, demeaned groups and explicit scenes. A word alone has no weight: there must be somebody it is
   said of, an address or a scene. Self-reference matches none, because the person in each pattern is another one.

A damped match keeps a tenth of its weight. The score of a text is ``1 - product(1 - best weight)`` over its clauses. Whole texts are read, quoted lines included.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.fst import Composed, Rewrite, Weighted

# The lexicon, symbol -> words. Plurals in -s are added to the symbols of PLURALS.
LEXICON = {
    "you be": "you're youre u're eres",
    "he be": "he's she's they're",
    "you": "you u ya yourself yourselves ur vous tu du ihr usted ustedes tú",
    "your": "your yo ton ta tes votre vos tus dein deine deinen deiner euer",
    "I": "i we i'd i'm im i'll we'll i've me us",
    "my": "my mine our myself",
    "he": "he she they them him these ces esos diese",
    "his": "his her hers their",
    "one": "somebody someone anybody anyone",
    "be": "are is was were be r being bist ist sind es est sont son",
    "will": "will would shall should must ought can could gonna going want wanna",
    "to": "to",
    "a": "a an the such what un una une ein eine einer einem einen le la les el los las de der die das den dem il lo gli",
    "that": "this that",
    "these": "those all most",
    "of": "of",
    "as": "as like",
    "people": "people folk folks race tribe peoples",
    "ADJ": "brainless rotten filthy stinking worthless disgusting spineless pathetic clueless miserable lying useless stupid dumb ugly incompetent ignorant moronic idiotic braindead cretinous imbecilic obnoxious nasty wretched vile despicable "
           "gutless witless mindless repulsive hideous cowardly loathsome contemptible deranged delusional retarded asqueroso asquerosa estúpido estúpida inútil sucio sucia pathétique stupide débile minable dämlicher dumm dummer dumme dreckige widerlicher widerliche",
    "adj": "fucking bloody goddamn damn dirty little lazy complete total utter absolute fat old big small sorry poor real bunch such so very really just too also always still clearly obviously truly verdammter verdammte verdammtes dreckiger blöder",
    "N": "idiot moron imbecile cretin halfwit dumbass bastard scumbag loser asshole arsehole jackass dickhead prick bitch slut whore cunt wanker twat douchebag douche motherfucker fucker retard nitwit dimwit simpleton "
         "buffoon dipshit shithead scum lowlife maggot dirtbag dolt nincompoop dunce ignoramus blockhead numbskull dullard fool coward clown parasite swine weasel sleazebag tosser git pillock bellend fuckwit asshat "
         "asswipe shitbag scoundrel crackpot degenerate pig imbécil idiota gilipollas pendejo cabrón connard connasse salaud salope salopard enculé ordure abruti crétin maricón zorra cerdo hurensohn wichser schlampe schwein drecksau vollidiot trottel depp arschloch dummkopf vollpfosten schwachkopf",
    "vulgar": "fuck fucked shit shitty crap bullshit merde mierda scheiße garbage trash filth hell",
    "kin": "mother mom mum father kids children wife sister parents family",
    "body": "face skull neck throat bones teeth legs knees fingers ribs brain brains head kneecaps arms nose",
    "disgust": "disgust disgusts sicken sickens repulse repulses puke vomit revolt revolts",
    "hit": "smash beat break kill strangle stab murder hurt crush slit burn choke punch slap hunt gut skin torture behead rape shoot hang slaughter",
    "die": "suffer die death pain agony bleed suffering dying cancer",
    "deserve": "deserve deserves hope pray",
    "find": "find know found",
    "G": "immigrant foreigner migrant refugee women woman females muslim jew christian gay lesbian black white gypsy asian african arab extranjeros inmigrantes étrangers immigrés ausländer einwanderer migranten flüchtlinge",
    "DEHUM": "vermin subhuman cockroach lice filth rat savage ungeziefer abschaum untermenschen plague disease breed cancer scum animal thieves parasite barbarian ratas basura vermine racaille chusma escoria",
    "inferior": "inferior subhuman lesser",
    "purge": "exterminate eradicate deport gas purge cleanse lynch expel",
    "trust": "hire trust let allow employ allowed",
    "vile": "breed breeds infest swarm multiply steal steals stink stinks leech rape",
    "land": "huts hut country countries cave caves jungle village villages desert homeland shithole",
    "person": "maintainer moderator developer dev reviewer author contributor manager guy man woman boss admin user ceo president colleague coder programmer teacher neighbour guys contributors maintainers moderators devs",
    "SEX": "porn porno cock pussy tits boobs panties orgasm blowjob milf anal cum penis vagina clit dildo threesome tit boob orgasms cocks nudes xxx",
    "strip": "naked nude horny erotic sexy nudity topless lingerie",
    "lewd": "undress moan moaning masturbate masturbating lick stroke stroked stroking seduce thrust thrusting fondle fondled grope groped spank sex sexual",
    "flesh": "thighs lips nipples breasts breast buttocks butt ass crotch cleavage bosom",
    "shots": "pictures pics photos photo video videos clips cams cam selfies girls boys housewives singles babes women teens chat",
    "baby": "baby babe honey darling",
    "NOT": "not never no don't dont isn't isnt aren't arent wasn't wasnt weren't werent doesn't doesnt didn't didnt won't wont wouldn't wouldnt shouldn't shouldnt mustn't ain't cannot can't cant nobody none neither nicht kein keine pas jamais nothing hardly",
    "only": "only",
    "back": "just merely simply but better more less than even wait hesitate stop rest fail mind regret help without",
    "deem": "think believe mean meant imply implied implying claim suggest suggested suggesting find consider feel assume thinks believes",
    "call": "call calling",
    "say": "said says say saying told tells wrote writes called calls shouted yelled claimed claims",
    "term": "insult insults insulting insulted slur slurs harasser harassers harassment wording quote quotes quoted offensive abusive banned forbids forbidden reported flagged phrase removed",
    "some": "some which",
    "go": "go get crawl geh va",
    "in": "in into with from near by over for",
    "where": "where",
}
PLURALS = ("N", "G", "DEHUM")

# Set phrases, symbol -> phrases apart by |; words of the lexicon may also stand as <symbol>, ? makes a word optional.
PHRASES = {
    "OFF": "shut the fuck up|shut your <adj>? mouth|shut your fucking mouth|fuck off|fuck you|fuck u|f u|f you|screw you|go to hell|burn in hell|rot in hell|go fuck yourself|eat shit|piss off|stfu|gtfo|drop dead|up yours|go to <vulgar>|"
           "va te faire foutre|va te faire enculer|cierra la boca|cállate la boca|que te jodan|vete al infierno|fahr zur hölle|fick dich|leck mich am arsch|ferme ta gueule|ta gueule|nique ta mère|vete a la mierda|halt die fresse|halt deine fresse|halt dein maul|verpiss dich|crawl back into|crawl back under|crawl away and|get lost <you>",
    "KYS": "kys|kill yourself|hang yourself|go die|drink bleach|neck yourself|jump off a bridge|jump off a cliff|jump in front of a train|end your life|do the world a favour and die|die in a fire|geh sterben|häng dich auf|va mourir|muérete",
    "HOME": "where you live|where you sleep|where your family lives|where you work|your home address",
    "PUKE": "me das asco|me dais asco|du ekelst mich an|tu me dégoûtes|vous me dégoûtez|make me puke|makes me puke|make me sick|makes me sick|make me vomit|makes me vomit|turns my stomach|turn my stomach",
    "N": "piece of <vulgar>|pile of <vulgar>|sack of <vulgar>|bag of <vulgar>|load of <vulgar>|waste of space|waste of oxygen|waste of skin|son of a bitch|hijo de puta|hija de puta|fils de pute|sack of <adj>? <vulgar>",
    "you": "espèce de|especie de|pedazo de|bande de",
    "BELITTLE": "tie your shoes|tie your own shoes|tie your shoelaces|tie your own shoelaces|count to ten|find your own ass",
    "BEAT": "beat the crap out of|beat the shit out of|beat the hell out of|kick the shit out of|kick the crap out of|knock the teeth out of|beat the living <vulgar> out of|put a bullet in",
    "LIKEYOU": "just like you|exactly like you|same as you|just like your mother",
    "DOOM": "by blood|by nature|by birth|in a cage|in cages|on a train|in camps|no brain|no brains|no soul",
    "EXPEL": "wipe out|wipe them out|get rid of|drive out|round up|kick out|send back|ship back|keep out",
    "OUT": "driven out|kicked out|thrown out|wiped out|rounded up|shipped back|sent back|put down|put on a train|raus|fuera|dehors",
    "GOBACK": "go back to <your> <adj>? mud? <land>|go back to their <adj>? mud? <land>|go back to where you came from|go back where you came from|go back to where they came from|go back where they came from",
    "RIGHTS": "be allowed to|be permitted to|be trusted with|be allowed near",
    "BEND": "bend over|make you scream|make you moan|make her scream|make me moan|deep inside her|deep inside him|deep inside me|inside her|lips around me|lips around my|wear nothing|spread your legs|spread her legs|on your knees|go down on|take off your|pulled off her|ride me",
    "SERVE": "what you deserve|what is coming to you|what's coming to you|watch your back",
    "FAVOUR": "do us all a favour|do us a favour|do everyone a favour|do the world a favour|do us all a favor",
    "REFUSE": "refuse to|refuses to|refused to",
}
_TRIGGER = frozenset("trust demonym demonyms ADJ N vulgar disgust hit die G DEHUM purge vile SEX strip lewd flesh inferior land".split())
_KEYS = frozenset("screw hell dead bleach bridge cliff puke sick stomach gueule maul fresse shoes shoelaces cage blood train huts scream moan live sleep inside bend lips cages crawl kys stfu gtfo u f refuse mud lost kicked thrown wipe wiped driven mother deserve asco dégoûtes ekelst foutre enculer fick hölle sterben mourir infierno jodan raus fuera dehors piss live kick mouth fucking disgusting".split())

# Chunks. Symbols: MAN a person spoken of, FOLK a group of people, N an insult.
CHUNKS = [
    ("[a these some]? [ADJ adj]{0,4} N", "N"), ("these N", "N"), ("[a these] x N", "N"),
    ("[a these]? adj of [ADJ adj]{0,3} N", "N"), ("you people", "you"), ("you all", "you"),
    ("[a these]? [adj ADJ]{0,2} person", "MAN"), ("that person", "MAN"), ("name be", "MAN be"),
    # A group by construction: "those quorish people", "the Tarkese", "Zemlans", and the plain nouns for groups.
    ("[a these]? [adj ADJ]{0,2} G people?", "FOLK"), ("[a these] [demonym demonyms name names x] people", "FOLK"), ("[a these] [demonym demonyms]", "FOLK"), ("demonyms", "FOLK"), ("these names", "FOLK"),
    ("[a]? [ADJ adj inferior]{0,3} DEHUM", "DEHUM"), ("a? inferior [DEHUM vile]", "DEHUM"), ("a? inferior people", "DEHUM"),
    # "was reported", ", he said": a report behind what it reports.
    ("be term", "tag"), (", [he person name x] say ,", ", tag ,"),
]

# Patterns: (kind, weight, pattern), each behind the rule of grammar that it states. "," is a break at a comma, "/" at a line end.
PATTERNS = [
    # predication: a person is an insult
    ("insult", 0.95, "[you he MAN FOLK] be [adj NOT deem back only]{0,3} N"), ("insult", 0.9, "your [x ADJ kin body]{1,3} be [adj NOT]{0,2} N"), ("insult", 0.9, "[you he] be [adj NOT as]{0,3} ADJ [, / $ a in to as]"),
    # address: you + insult, insult + you are
    ("insult", 0.95, "you x? [ADJ adj vulgar]{0,3} N"), ("insult", 0.95, "N you be"), ("insult", 0.95, "you be [adj NOT ADJ]{0,3} vulgar [, / $]"),
    # vocative: an insult that fills the stretch, in a clause that addresses somebody
    ("insult", 0.9, "[you your go OFF KYS BELITTLE] [^$]* [, /] x{0,2} N [, / $]"), ("insult", 0.9, "[^ / ,] [x find]? ,? N [, /] [^$]* [you your go OFF HOME]"), ("insult", 0.9, "[^] [x go find hi]? ,? N [, /] [^$]* [you your go OFF HOME]"),
    # dismissal: an imperative phrase that ends there, or goes on to its addressee
    ("insult", 0.9, "OFF [, / $ you your N ADJ I MAN]"), ("insult", 0.9, "OFF [in x] [your you]"),
    # generic agent: only/some insult does that
    ("insult", 0.85, "[only some] N [will x say]"), ("insult", 0.8, "some N"),
    # demonstrative: this/that + insult
    ("insult", 0.85, "that N [, / $ x NOT]"),
    # disgust: you make me sick
    ("insult", 0.9, "you adj? disgust [I / , $]"), ("insult", 0.85, "you [^,/$]{0,8} PUKE"), ("insult", 0.85, "your [^,/$]{0,6} PUKE [, / $]"), ("insult", 0.85, "[^] PUKE [, / $]"),
    # unfit: nobody would trust you with a child's task
    ("insult", 0.85, "NOT [trust find will] you [^,$]{0,3} BELITTLE"), ("insult", 0.8, "you NOT [^,$]{0,2} BELITTLE"),
    # simile: as ... as you; trash, just like you
    ("insult", 0.85, "as ADJ as [you your]"), ("insult", 0.85, "ADJ as your [body kin]"), ("insult", 0.85, "be a? [vulgar N ADJ] ,? LIKEYOU"),
    # the addressee's mother
    ("insult", 0.85, "your kin will [^$]{1,4} you"), ("insult", 0.9, "your kin be [adj]{0,2} [N vulgar ADJ]"),
    # nobody wants you
    ("insult", 0.75, "NOT x{0,1} [x as] you , [^$]* KYS"),
    # threats: I / somebody will harm you or your body
    ("threat", 0.95, "[I one] [^$]{0,8} find [^,$]{0,3} HOME"), ("threat", 0.9, "[I one] will [to x adj be]{0,3} hit you [, / $ in as]"), ("threat", 0.9, "NOT back to? hit [you your]"), ("threat", 0.95, "[I one] will [^,$]{0,5} hit [your his] x? [body kin]"),
    ("threat", 0.9, "[one I] will to? x? BEAT"), ("threat", 0.95, "[hit BEAT] your adj? body"), ("threat", 0.9, "one will to? [hit] [you he MAN]"),
    # death wishes
    ("threat", 0.9, "you x? deserve [^,$]{0,6} die"), ("threat", 0.9, "deserve [^,$]{0,2} you [^,$]{0,3} die"), ("threat", 0.9, "[FAVOUR go] [^$]{0,3} KYS"), ("threat", 0.9, "[^] adj? KYS"), ("threat", 0.9, "[, / you will x] x? KYS"), ("threat", 0.8, "I will [^,$]{0,6} SERVE"),
    # hate: a group is called less than human, by predicate, apposition, simile or fate
    ("hate", 0.95, "FOLK [be x adj NOT]{0,4} DEHUM"), ("hate", 0.95, "FOLK , DEHUM"), ("hate", 0.9, "FOLK [^$]{0,12} as a? DEHUM"), ("hate", 0.9, "FOLK [^$]* he [be] [^,$]{0,2} DEHUM"), ("hate", 0.95, "FOLK [^$]* DOOM"), ("hate", 0.95, "[DEHUM N] FOLK"), ("hate", 0.95, "DEHUM [be as] FOLK"),
    ("hate", 0.9, "FOLK be [adj]{0,2} [inferior N vulgar ADJ]"),
    # a group to be driven out or killed
    ("hate", 0.95, "[purge EXPEL hit] [of]? FOLK"), ("hate", 0.95, "FOLK will [be x to]{0,3} [OUT purge EXPEL hit die]"), ("hate", 0.95, "FOLK be OUT"), ("hate", 0.9, "keep FOLK out"), ("hate", 0.9, "FOLK ,? [OUT]"), ("hate", 0.9, "OUT FOLK"),
    # a group denied what others have
    ("hate", 0.9, "FOLK will NOT [be RIGHTS x trust]{1,2}"), ("hate", 0.9, "FOLK NOT RIGHTS"), ("hate", 0.9, "NOT trust FOLK"), ("hate", 0.9, "REFUSE [^,$]{1,5} [in] FOLK"), ("hate", 0.9, "NOT [^,$]{1,2} [in] FOLK [, / $]"),
    # sent home
    ("hate", 0.9, "GOBACK"),
    # them: two demeaning verbs in a row
    ("hate", 0.9, "he vile [, x]{1,2} he? vile"),
    # sexual: an explicit noun with another explicit word, somebody's, or on offer
    ("sexual", 0.95, "[SEX strip lewd flesh] [^$]* SEX"), ("sexual", 0.95, "SEX [^$]* [strip lewd flesh BEND]"), ("sexual", 0.95, "[his your my] [x adj strip ADJ]{0,2} SEX"), ("sexual", 0.9, "he [x adj]{1,3} SEX"), ("sexual", 0.9, "[x adj] SEX shots"), ("sexual", 0.9, "SEX [^$]{0,6} shots"),
    # undressed people and their pictures
    ("sexual", 0.9, "strip [shots baby]"), ("sexual", 0.9, "strip [^,$]{0,2} shots"), ("sexual", 0.9, "[I he] x? [you he] strip"), ("sexual", 0.9, "I will you strip"),
    # acts on somebody
    ("sexual", 0.9, "lewd [^,$]{0,3} [you he his your]"), ("sexual", 0.95, "vulgar [he his]"), ("sexual", 0.9, "lewd in [you I he]"),
    # scenes: two suggestive elements
    ("sexual", 0.9, "[BEND flesh lewd strip baby] [^$]* BEND"), ("sexual", 0.9, "BEND [^$]* [BEND flesh lewd strip baby]"), ("sexual", 0.9, "[flesh strip lewd] [^$]* [lewd strip]"),
]

#: A line of more characters than this is wrapped text, and its end no break.
WRAPPED = 45
_TOKEN = re.compile(r"(?P<b>[.!?…]+(?=[\s\"'”<)\]]|$)|\n\s*\n|\n\[\d|\n\s*[-*#•] |</?[a-zA-Z][^>]{0,40}>)|(?P<s>[,;:–—]|[!?])|[\w@$*][\w@$*'’+-]*")
_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "’": "'"})
_RUN = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<![\w-])(?:[A-Za-z][ .](?=[A-Za-z](?![A-Za-z]))){2,}[A-Za-z](?![\w-])")
# Names of peoples by their endings: as a collective ("the ...ese"), as a plural ("...ians").
_DEMONYM, _DEMONYMS = re.compile(r"(?:ese|ish|[^\Waeiou\d_]i)$"), re.compile(r"(?:ans|ites|[^\Waeiou\d_]is)$")


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


class Speller(dict):
    """token -> symbol: every token is worked out once. A word that only phrases know is a symbol of its own, ``=word``."""

    def __init__(self):
        super().__init__()
        self.words: dict[str, str] = {}
        for symbol, words in LEXICON.items():
            for w in words.split():
                for form in (w, *([w + "s", w + "es"] if symbol in PLURALS else ())):
                    self.words.setdefault(form, symbol)
        phrase_words = {w.rstrip("?") for v in PHRASES.values() for p in v.split("|") for w in p.split() if w[0] != "<"}
        # A word of a phrase keeps its spelling; ``plain`` is what it stands for outside the phrase.
        self.plain = {f"={w}": self.words.get(w, "x") for w in sorted(phrase_words)}
        self.words.update({w: f"={w}" for w in phrase_words})
        for w in list(self.words):
            self.words.setdefault(_fold(w), self.words[w])
        self.heavy = {s for s in (*self.words.values(), *self.plain) if self.plain.get(s, s) in _TRIGGER or s.lstrip("=") in _KEYS}
        self.strong = {w: s for w, s in self.words.items() if len(w) >= 3 and s in self.heavy}
        self.by_length: dict[int, list[str]] = {}
        for w in self.strong:
            self.by_length.setdefault(len(w), []).append(w)

    def _spell(self, token: str) -> str:
        t = token.lower()
        got = self.words.get(t) or self.words.get(_fold(t))
        if got:
            return got
        if t.endswith("'s") and (got := self.words.get(t[:-2])):
            return got
        if "-" in t:
            parts = t.split("-")
            return self._spell("".join(parts)) if len(parts) > 2 and all(len(p) <= 1 for p in parts) else "x"
        if "*" in t:
            shape = re.compile(re.escape(t).replace(r"\*", "."))
            return next((self.strong[w] for w in self.by_length.get(len(t), ()) if shape.fullmatch(w)), "x")
        plain = t.translate(_LEET)
        if plain != t and not t.isdigit() and len(plain) >= 2:
            got = self.words.get(plain) or self.words.get(plain.strip("'"))
            if got:
                return got
        if _RUN.search(plain):
            for repeat in (r"\1", r"\1\1"):
                if got := self.words.get(_RUN.sub(repeat, plain)):
                    return got
        if t.startswith("@") and t[1:].isalpha():
            return ","
        # A capital letter marks a name; shouted or disguised words may be names, too, if they end like a people's.
        if token[:1].isupper() and len(token) > 3 and plain.isalpha():
            named = token[1:].islower()
            return "demonyms" if _DEMONYMS.search(plain) else "demonym" if _DEMONYM.search(plain) else "x" if not named else "names" if t.endswith("s") else "name"
        return "x"

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        s = self[token] = self._spell(token)
        return s


class Negation:
    """Damps the predicates that a negation governs. A state is (mode, symbols left): idle, scope, or opinion ("don't think (that) you are ...")."""

    start = ("idle", 0)
    REACH = 6
    PREDICATE = frozenset("N ADJ vulgar DEHUM inferior hit BEAT disgust".split())
    THROUGH = frozenset("be x a adj to will he MAN FOLK these some of as find".split())

    def step(self, state: tuple, s: str) -> tuple[tuple, tuple]:
        mode, left = state
        if s == "NOT":
            return (("scope", self.REACH) if mode == "idle" else self.start), (s,)
        if mode == "idle":
            return state, (s,)
        if mode == "asked":
            return (("scope", left - 1) if s == "be" else self.start), (s,)
        if s in self.PREDICATE:
            # Adjectives go on to their noun; the noun ends the scope.
            return ((mode, left - 1) if s == "ADJ" and left > 1 else self.start), ("~" + s,)
        if left <= 1 or s in (",", "back", "only"):
            return self.start, (s,)
        if s in ("deem", "say"):
            return ("opinion", self.REACH), (s,)
        if s == "call":
            return ("named", self.REACH), (s,)
        if s == "you":
            return {"opinion": ("asked", left - 1), "named": ("scope", left - 1)}.get(mode, self.start), (s,)
        if s in self.THROUGH or mode == "opinion" or s == "/":
            return (mode, left - 1), (s,)
        return self.start, (s,)

    def end(self, state: tuple) -> tuple:
        return ()


class Report:
    """Damps what stands in reported speech or is talked about as a wording. A state is (symbols left, symbols since the report, who spoke last)."""

    start = (0, 9, "")
    REACH = 20
    MARKED = frozenset("N ADJ vulgar DEHUM inferior hit BEAT disgust OFF KYS PUKE GOBACK DOOM EXPEL OUT purge die vile SEX strip lewd flesh BEND BELITTLE LIKEYOU".split())

    def step(self, state: tuple, s: str) -> tuple[tuple, tuple]:
        left, since, who = state
        plain = s.lstrip("~")
        if plain in ("I", "he", "one", "MAN", "you", "NOT"):
            who = plain
        if plain == "term" or (plain == "say" and who not in ("I", "you")):
            return (self.REACH, 0, who), (s,)
        if plain in (",", "/"):
            # A break right behind the reporting word opens what it reports; any other break closes it.
            return ((left - 1, since + 1, "") if left > 1 and since <= 1 and plain == "," else (0, 9, "")), (s,)
        if left > 0 and plain in self.MARKED:
            s = "~" + plain
        return (max(left - 1, 0), min(since + 1, 9), who), (s,)

    def end(self, state: tuple) -> tuple:
        return ()


def _phrase_rules(plain: dict[str, str]) -> list[tuple[str, str]]:
    out = []
    for symbol, phrases in PHRASES.items():
        for phrase in phrases.split("|"):
            out.append((" ".join((_alternatives(w.strip("<>?"), plain) if w[0] == "<" else f"={w.rstrip('?')}") + ("?" if w.endswith("?") else "") for w in phrase.split()), symbol))
    return out


def _alternatives(symbol: str, plain: dict[str, str]) -> str:
    return f"[{' '.join([symbol, *(w for w, s in plain.items() if s == symbol)])}]"


class Grammar:
    """Scores of single texts."""

    def __init__(self):
        self.symbol = Speller()
        plain = self.symbol.plain
        special = {"=keep": "keep", "=out": "out"}
        phrases = Rewrite(_phrase_rules(plain), lambda s: special.get(s, plain.get(s, s)))
        self.machine = Composed(phrases, Rewrite(CHUNKS, lambda s: "x" if s in ("name", "names", "demonym", "demonyms") else s), Negation(), Report(), Weighted(PATTERNS))

    def clauses(self, text: str) -> list[tuple[list[str], bool]]:
        """(symbols, whether one of them can carry weight) of each clause."""
        text = text.replace("​", "").replace("­", "")
        text = _SPACED.sub(lambda m: re.sub(r"[ .]", "", m.group()), text)
        out, now, symbol, heavy, end, some = [], [], self.symbol, self.symbol.heavy, 0, False
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            at = text.find("\n", end, m.start()) if now else -1
            if at >= 0 and at - text.rfind("\n", 0, at) <= WRAPPED:
                now.append("/")
            end = m.end()
            if kind == "b":
                if now:
                    out.append((now, some))
                    now, some = [], False
            elif kind == "s":
                now.append(",")
            else:
                s = symbol[m.group()]
                some = some or s in heavy
                if " " in s:
                    now.extend(s.split())
                else:
                    now.append(s)
        if now:
            out.append((now, some))
        return out

    def score(self, text: str | None) -> tuple[float, dict[str, float]]:
        """(score, best weight by kind)."""
        rest, kinds = 1.0, {}
        for symbols, some in self.clauses(text or ""):
            if some:
                best = 0.0
                for kind, weight in self.machine.run(symbols):
                    best = max(best, weight)
                    kinds[kind] = max(kinds.get(kind, 0.0), weight)
                rest *= 1.0 - best
        return 1.0 - rest, kinds


def _scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grammar, kinds = Grammar(), ("insult", "threat", "hate", "sexual")
    for batch in batches:
        got = [grammar.score(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("k"), batch.column("source"), pa.array([round(s, 6) for s, _ in got], pa.float64())]
        columns += [pa.array([k.get(kind, 0.0) for _, k in got], pa.float64()) for kind in kinds]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "source", "score", *kinds])


def unsafe_scores(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, score, insult, threat, hate, sexual): one row per row of ``df``, score in [0, 1] over the whole text and the
    best weight of each kind. No shuffle. Null and empty texts score 0; repeated rows are scored each; null keys and sources stay."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(source).alias("source"), F.col(text).alias("text"))
    out = rows.mapInArrow(_scorer, "k long, source string, score double, insult double, threat double, hate double, sexual double")
    return out.withColumnRenamed("k", key)


def unsafe_rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source: n_documents, n_unsafe, rate, mean_score."""
    unsafe = F.count_if(F.col("score") >= threshold)
    return scores.groupBy("source").agg(F.count("*").alias("n_documents"), unsafe.alias("n_unsafe"), F.round(unsafe / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
