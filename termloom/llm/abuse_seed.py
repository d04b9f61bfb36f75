"""Seed sentences for the abuse model: general templates with slots, expanded by rule.

The first list is what a writer may say to or about people anywhere; the second uses the same vocabulary about things,
animals or oneself, in reports of abuse suffered, or in clinical wording. Written by hand, without regard to the
wording of any corpus; what is usual in a corpus is learnt from its labels.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np

SLOTS = {
    "noun": "idiot moron loser scumbag pig coward imbecile liar jerk bastard bitch clown creep fool rat leech".split(),
    "adj": "stupid useless worthless pathetic disgusting dumb miserable ugly lazy filthy".split(),
    "vermin": "vermin parasites animals savages rats filth scum".split(),
    "harm": "kill stab strangle shoot beat punch burn choke".split(),
    "sex": "fuck lick suck ride spank".split(),
    "body": "ass tits cock pussy breasts thighs".split(),
    "hot": "horny naked sexy kinky nude".split(),
    "group": "immigrants refugees foreigners muslims jews gays lesbians blacks women gypsies pensioners".split(),
    "thing": "laptop kettle lawnmower website printer alarm bicycle parking".split(),
    "ill": "rash cough ulcer fever headache cramp".split(),
    "pet": "cat dog parrot hamster horse".split(),
    "kin": ["her brother", "an uncle", "his boss", "the landlord", "a stranger", "a former friend"],
}

HARSH = """
you really are the most {adj} {noun} i ever met|nobody likes you, {noun}|what kind of {adj} {noun} writes this|oh look, the {noun} is talking again|crawl away and never come back, {noun}|you disgust me, you {adj} {noun}
how can one person be this {adj}, you {noun}|your whole family are {noun}s|everyone laughs at you, {adj} {noun}|you {noun} ruined everything|go to hell, {noun}|stfu {noun}|fuck you|fuck off, {noun}|eat shit, {noun}|screw you and your kind
i am going to {harm} you|i swear i will {harm} you tonight|i'll {harm} you and your kids|wait outside, i want to {harm} you|say that again and i {harm} you|you will be dead by the weekend|i have a knife and i know your address|somebody ought to {harm} you
i wish you were dead|just kill yourself already|please go hang yourself|drop dead, {noun}|hope a truck hits you|may you suffer for years|i pray you get cancer|you deserve to be beaten|do everybody a favour and die
pure {vermin}, these {group}|those {group} are all {vermin}, every single one|we have too many {group}, get rid of them|deport all the {group}|{group} should not be allowed to have children|gas the {group}|{group} are stupid by nature|i hate {group}, they are {vermin}
a {group} doctor, no thanks, they are {vermin}|kick the {group} out of our town|{group} spread diseases, keep them away from decent people|no decent person wants {group} around|{group} belong in a cage|the only good {group} are dead {group}
i want to {sex} you so bad|let me {sex} your {body}|show me your {body}, baby|send a picture of your {body}|you make me so {hot}, come to bed with me|wanna have sex with you right now|she wants his {cock} in her mouth|he came inside her|her {body} bounced while he fucked her
watch {hot} girls live on cam|{hot} milfs near you want to {sex}|i would love to {sex} that {body}|he grabbed her {body} and pushed into her|she spread her legs and moaned|he ripped her dress off and {sex}ed her|spread your legs for me|i dream of your {body}
tu es un vrai {fr}|espèce de {fr}|ferme-la, {fr}|je vais te frapper|je te tuerai|crève, {fr}|les étrangers sont des parasites|les immigrés sont de la racaille, dehors|j'ai envie de te baiser|montre-moi tes seins|va te faire foutre
"""
SLOTS["cock"] = ["cock", "dick"]
SLOTS["fr"] = "con connard salaud imbécile ordure idiote crétin".split()

MILD = """
this {thing} is so {adj}|the {adj} {thing} died on me again|i hate my {thing}|my {thing} makes me want to scream|that {thing} is a piece of junk|fix your {adj} {thing} please|i want to throw the {thing} out of the window
my {pet} is a lazy {noun}|the {pet} bit me, that little rat|our {pet} is ugly but we adore it|we saw rats and parasites in the barn|the farm keeps pigs and other animals
i am a {adj} {noun} sometimes|i feel {adj} and tired|i was so {adj} to forget it|i called myself an idiot|i could kill for a sandwich|this {ill} will be the death of me|my {ill} is killing me|this {adj} {ill} will not go away
she says that {kin} called her a {adj} {noun}|he was told by {kin} that he would be killed|{kin} threatened to {harm} him, report made|the patient was beaten by {kin}|she was raped as a teenager and sees a counsellor|he hears voices that say you are worthless|he denies wanting to {harm} anyone
victim of assault by {kin}, wounds cleaned|other pupils call him a {noun}, he stays at home|{kin} sends her messages like i will find you, she called the police|reports that {kin} said {group} are {vermin}, which upset her
examination of the breasts was normal|no discharge from the penis|sexual history taken in private|pain with intercourse for two months|advice on condoms and contraception|genital warts treated|the skin of the thighs is dry|the patient undressed for the examination|anal fissure, stool softener given
{group} are welcome at the clinic|a service for {group} opens next month|vaccines for {group} are free|{group} have a higher risk of {ill}|talks with {group} about their health|many {group} wait too long for an appointment
you should see a doctor about that {ill}|i hope you feel better soon|you are very kind, thank you|your results are back|you will be called by the desk|have you tried an ice pack|shut the door, it is cold|you must rest and drink|please burn the old records|shoot me an email
cut the tablet in half|strangulated hernia was ruled out|stab wound of the arm, two stitches|burn of the hand by hot oil|she had a stroke and cannot walk|a punch biopsy was taken|the choke point is the front desk|beat the eggs, then wait
le médecin est gentil|je vais mieux, merci|il a été frappé par un inconnu|la douleur me tue|ce chat est un idiot|les étrangers peuvent demander une carte|examen des seins normal
"""


def sentences(per_template: int = 30, seed: int = 7) -> tuple[list[str], list[int]]:
    """Expanded templates with labels 1 and 0; a fixed number whatever the data."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for label, block in ((1, HARSH), (0, MILD)):
        for t in (t for line in block.strip().splitlines() for t in line.split("|")):
            slots = re.findall(r"{(\w+)}", t)
            seen = set()
            for _ in islice(range(per_template), per_template if slots else 6):
                s = re.sub(r"{(\w+)}", lambda m: str(rng.choice(SLOTS[m[1]])), t)
                if s not in seen or not slots:
                    seen.add(s)
                    texts.append(s)
                    labels.append(label)
    return texts, labels
