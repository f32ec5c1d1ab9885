"""Fixed values about personal names, shared by the operators on people."""

# Common given names in English, German, French and Spanish, and short forms in use on their own.
GIVEN = """
aaron adam adrian agnes albert alex alexander alice amanda amelia andrea andreas andrew angela anna anne anthony antonio arthur barbara beatrice ben benjamin
bernard bob bruno camille carl carla carlos carmen caroline catherine charles charlotte chloe chris christina christine christopher claire clara claudia
clement dan daniel david deborah denis diana diego dolores dominic dorothy edith edward eleanor elena elizabeth ella emil emily emma eric esther eva felix
fernando florian francesca francis francisco fred frederick friedrich gabriel gabriela george gerald guillaume hannah hans harry heinrich helen henry hugo
ignacio ines ingrid jonah karla irene isaac isabel isabella jacob james jan jane jean jeanne jennifer jim joan johannes john jonas jonathan jorge jose josef joseph
josephine juan judith julia julian karen karl katherine katrin kenneth klaus laura lena leon leonard linda lisa lucas lucia lucy luis lukas magdalena manuel
marco margaret maria marie mario marta martha martin mary mateo matthew maurice michael miguel monika nadia nancy nicholas nicole nina noah nora oliver oscar
pablo patricia patrick paul paula pavel peter philip pierre rachel raphael rebecca rene richard robert roger rosa rosalind ruth sam samuel sandra sara sarah
sebastian simon simone sofia sophie stefan stephen susan susanna sven sylvia teresa theo theodore theresa thomas tim timothy tobias tom tomas ulrike ursula
valerie vera victoria vincent walter werner william xavier yusuf yvonne zachary zoe
""".split()

# Short forms of given names and the full names they may stand for.
SHORT_FORMS = {
    "alex": "alexander alexandra", "sasha": "alexander alexandra", "sandy": "alexander sandra", "andy": "andrew andreas", "tony": "anthony antonio", "toni": "antonio antonia",
    "bella": "isabella", "ben": "benjamin", "benny": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth",
    "lisa": "elizabeth", "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william", "bob": "robert", "rob": "robert", "bobby": "robert",
    "cathy": "catherine", "kate": "katherine catherine", "katie": "katherine catherine", "kathy": "katherine", "kat": "katherine", "charlie": "charles charlotte",
    "chris": "christopher christian christina christine", "kit": "christopher katherine", "clem": "clement", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah",
    "debbie": "deborah", "dima": "dmitri", "dolly": "dolores", "lola": "dolores", "ed": "edward", "eddie": "edward", "ted": "edward theodore", "ned": "edward", "ellie": "eleanor",
    "nell": "eleanor", "nora": "eleanor", "lena": "helena magdalena", "fran": "francesca francisco", "frank": "francis francisco", "paco": "francisco", "pancho": "francisco",
    "fred": "frederick friedrich", "freddie": "frederick", "fritz": "friedrich", "gabi": "gabriela gabriel", "gaby": "gabriela", "gabe": "gabriel", "greg": "gregory",
    "guy": "guillaume", "lupe": "guadalupe", "etta": "henrietta", "hetty": "henrietta", "hen": "henrietta", "harry": "henry harold", "nacho": "ignacio", "jack": "john", "johnny": "john jonathan",
    "jon": "jonathan", "jim": "james", "jimmy": "james", "jamie": "james", "joe": "joseph", "pepe": "jose", "jo": "josephine joanna", "josie": "josephine", "hannes": "johannes", "hans": "johannes",
    "jules": "julian julia", "kai": "nicholas", "ken": "kenneth", "len": "leonard", "leo": "leonard leopold", "leon": "leonard", "maggie": "margaret magdalena", "peggy": "margaret", "meg": "margaret", "greta": "margaret",
    "magda": "magdalena", "matt": "matthew", "max": "maximilian", "mike": "michael", "mick": "michael", "nick": "nicholas", "nico": "nicholas nicolas", "nicky": "nicholas nicole",
    "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip", "rafa": "rafael", "rick": "richard", "dick": "richard", "rich": "richard", "roz": "rosalind", "ros": "rosalind",
    "sam": "samuel samantha", "seb": "sebastian", "bastian": "sebastian", "basti": "sebastian", "steve": "stephen", "sue": "susanna susan", "susie": "susanna susan", "susi": "susanna", "tess": "theresa", "theo": "theodore", "tim": "timothy",
    "tom": "thomas", "tommy": "thomas", "toby": "tobias", "ulli": "ulrike", "vic": "victoria victor", "vicky": "victoria", "tori": "victoria", "walt": "walter", "xeni": "xenia",
    "zach": "zachary", "zack": "zachary", "zac": "zachary", "zoli": "zoltan", "manny": "manuel", "manu": "manuel", "nadja": "nadia", "cami": "camille", "al": "albert alan", "bert": "albert robert", "gus": "august", "emmy": "emily emilia", "lenny": "leonard", "tobi": "tobias", "mandy": "amanda",
    "isa": "isabella", "babs": "barbara", "chessie": "francesca", "tricia": "patricia", "hettie": "henrietta", "tilde": "mathilde", "uli": "ulrike", "izzy": "isabella", "jerry": "gerald", "larry": "lawrence", "hattie": "harriet",
}
SHORT_FORMS = {short: forms.split() for short, forms in SHORT_FORMS.items()}
# Legal forms of organisations, with their short forms.
LEGAL_FORMS = {
    "inc": "inc", "incorporated": "inc", "ltd": "ltd", "limited": "ltd", "co": "co", "company": "co", "ag": "ag", "aktiengesellschaft": "ag", "gmbh": "gmbh", "sa": "sa", "cooperative": "coop",
    "coop": "coop", "corp": "corp", "corporation": "corp", "llc": "llc", "plc": "plc", "kg": "kg", "srl": "srl", "sarl": "sarl", "bv": "bv", "nv": "nv", "ev": "ev", "gesellschaft": "gmbh", "mbh": "gmbh",
}
