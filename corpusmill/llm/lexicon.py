"""Small word lists of common function words, written for this project; one string per language."""

FUNCTION_WORDS = {
    "it": "il lo la i gli le l un uno una di del dello della dell dei degli delle a al allo alla all ai agli alle da dal dalla dall dai in nel nella nell nei nelle con su sul sulla sull sui per tra fra e ed o ma anche se che chi cui non è era sono ha hanno ho ne si ci mi ti vi come più questo questa quello perché quando dove poi già molto ogni ancora mentre dopo prima secondo così quindi però sua suo loro essere stato due anni fa",
    "en": "the a an of to in on at by for from with and or but so that this these those it its he she they we you i is are was were be been has have had not never no as if who which what when where why how there their his her our your my than then because although while after before about into over under out up down all every each some any more most only also very just will would can could do does did said",
    "fr": "le la les l un une des de du d à au aux en dans sur sous par pour avec sans et ou mais que qui quoi ne n pas plus est sont était a ont il elle ils elles on nous vous je ce cette ces son sa ses leur se s y comme si quand où parce alors puis très tout tous chaque après avant pendant lorsque selon qu c été fait deux ans",
    "es": "el la los las un una unos unas de del a al en con por para sin sobre entre y e o u pero que quien qué no ni es son era fue ha han se su sus lo le les me te nos mi este esta ese esa eso como más muy cuando donde porque aunque mientras después antes ya también todo todos cada según hace dos años nadie",
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas num numa por pelo pela para com sem sobre entre e ou mas que quem não é são era foi há se seu sua seus suas lhe me nos este esta esse essa isso como mais muito quando onde porque embora enquanto depois antes já também todo todos cada segundo ao aos à às ainda ninguém disso",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass daß wenn als ob ist sind war waren hat haben wird wurde nicht kein keine nie zu zum zur in im an am auf aus bei mit nach von vom vor für über unter durch gegen ohne um er sie es wir ihr ich sich sein seine ihre wie was wer warum wo so auch noch nur schon sehr jeden jedes davon laut jahren",
    "ro": "un o al a ai ale de la în din pe cu pentru prin spre fără sub între și sau dar că care cine ce nu este sunt era a au fost se își lui ei lor el ea ei noi voi eu mai foarte când unde deoarece deși după înainte toate fiecare acest această acea iar tot încă nimeni",
    "nl": "de het een en of maar want van in op te aan met voor door uit over bij naar om dat die dit deze is zijn was waren heeft hebben niet geen ook nog wel al als wie wat waar hoe er hij zij wij ik je zich hun haar",
    "ru": "и в на с к по из за от до у о об не ни но а что как это то так же бы ли если когда где кто он она они мы вы я его её их был была было были есть для без под над при после перед между потому чтобы который которая все весь уже ещё только очень год никто",
    "el": "ο η το οι τα του της των τον την στο στη στην στον στις στους με για από σε και ή αλλά ότι που δεν μη είναι ήταν έχει ένας μια ένα ως όταν γιατί πριν μετά όπως αυτό αυτή κάθε πολύ ακόμη κανείς",
    "ar": "في من على إلى عن مع و أو لكن أن إن ما لا لم لن هو هي هم هذا هذه ذلك التي الذي كان كانت قد كل بعد قبل عند حتى إذا كما ثم بين منذ هل لماذا لأن بينما أحد",
    "hi": "का के की को से में पर ने और या लेकिन कि यह वह ये वे है हैं था थी थे नहीं भी तो ही जो क्या कौन कब कहाँ क्यों एक दो पहले बाद लिए साथ तक ऐसा जब जबकि क्योंकि कल पास",
}

#: Characters that carry grammar in scripts written without spaces.
FUNCTION_CHARS = "的了在是我们不这那有和为什么而很着过把被也就都与吗呢" + "はのをにがとでたてもるしかれいなあるだっ"
