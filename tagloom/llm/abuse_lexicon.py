"""Words and phrases of the weighted lexicon, its exception phrases, and the tables of the folding.

The lists are our own choice, from general knowledge of the four languages.

Everything is plain text in four languages; ``abuse`` folds it in the same way
as it folds documents.  ``{a|b}`` stands for its alternatives.
"""

# Words that are abusive wherever they stand, unless an exception covers them.
INSULTS = """
idiot idiots moron morons imbecile imbeciles cretin cretins dumbass dumbasses asshole assholes arsehole bastard bastards bitch bitches
scumbag scumbags motherfucker dickhead wanker whore whores slut sluts cunt cunts retard faggot subhuman subhumans dipshit shithead
schwachkopf schwachkopfe vollpfosten missgeburt wichser drecksau arschloch arschlocher hurensohn fotze schlampe vollidiot idioten untermensch dreckschwein
imbecil imbeciles idiota idiotas cabron cabrones gilipollas subnormal subnormales hijoputa zorra malparido pendejo mierdoso
nigger niggers nigga niggas spic spics kike kikes wetback wetbacks gook gooks raghead ragheads towelhead towelheads paki pakis faggots fags tranny trannies shemale retards
halfwit halfwits nitwit nitwits dimwit dimwits numbskull bonehead jackass jackasses douchebag douchebags douche twat twats tosser bellend fuckface fucker fuckers fuckwit fuckhead dumbfuck dumbfucks
motherfuckers cocksuckers skank skanks scumbags lowlife lowlifes asshat asswipe shitbag shitheads dickheads wankers bastards arseholes subhumans fatso lardass whoreson simpleton nincompoop
kanake kanaken neger negers schwuchtel schwuchteln spast spasti spasten hure huren nutte nutten schlampen trottel volltrottel depp deppen dummkopf dreckskerl miststuck mistkerl drecksack penner mongo
hurensohne fotzen idiotin arsch arschgeige vollhonk hackfresse scheisskerl drecksvolk
maricon maricones puta putas puto putos sudaca sudacas tarado tarada retrasado retrasados mongolo capullo capullos cretino cretina bastardo bastarda zorras pendejos culero lameculos hijoputas mamon soplapollas payaso
黑鬼 支那猪 死基佬 死娘炮 尼哥 绿茶婊 臭婊子 智障 弱智 傻子 狗东西 狗杂种 龟儿子 王八羔子 混蛋 全家死光 死全家 去你妈 操你 日你妈 肥猪 死胖子 母狗 低能儿 死变态 垃圾人 贱种 蠢猪 蠢驴 猪头 小人渣 傻屌 煞逼 尼玛 你妈死了 丧门星
傻逼 傻比 煞笔 沙比 傻叉 王八蛋 贱人 贱货 脑残 蠢货 畜生 废物 费物 白痴 婊子 狗娘养的 人渣 混账东西 杂种 滚犊子 草泥马 操你妈 尼玛死
""".split()

# Of these, slurs against groups of people.
SLURS = set(
    """
nigger niggers nigga niggas spic spics kike kikes wetback wetbacks gook gooks raghead ragheads towelhead towelheads paki pakis faggot faggots fags tranny trannies shemale retard retards subhuman subhumans untermensch kanake kanaken neger negers schwuchtel schwuchteln spast spasti spasten maricon maricones sudaca sudacas subnormal subnormales retrasado retrasados mongolo
""".split()
)

# Explicit sexual words that a text about clothes has no use for.
EXPLICIT = """
porn porno pornos pornhub blowjob handjob cumshot dildo nudes horny pussy tits titties cocksucker masturbate masturbating orgasm
ficken fickt titten muschi nacktbilder nacktfotos wichsen
blowjobs handjobs cumshots dildos milf gangbang creampie deepthroat bukkake fellatio cunnilingus upskirt upskirts titjob camgirl hentai xxx
fickfoto fickfotos porno pornos pornografisch muschis schwanzlutscher upskirtfotos nacktvideo nacktvideos bumsen blasen
follar follarte follarme follarla pollas mamada mamadas corrida tetona tetonas chochos masturbarme masturbarse tetas polla cachondo cachonda pornografia
黄色视频 色情 成人片 自慰 手淫 射精 乳交 肛交 内射 援交 嫖娼 裸体照 裸体视频 上床 一夜情 开房 性交易 操逼 鸡巴 奶子 黄片 果照 裸照 裸聊 约炮 约泡 做爱 打飞机 口交 淫荡 骚货 艹模特 操模特 偷拍裙底
""".split()

# Phrases that are abusive in themselves.
PHRASES = """
piece of {shit|crap|filth|garbage}
{human|absolute} {garbage|trash|waste|filth}
waste of {space|air|oxygen|skin}
shut {up|your mouth|your face|your trap|the fuck up}
{fuck|screw|damn} you
fuck {off|yourself|him|her|them|your mother}
{go to|rot in|burn in} hell
drop dead
{kill|hang|shoot|drown} yourself
{crawl|go} back {under|to} your {rock|hole|cave|country}
son of a {bitch|whore}
{halt|haltet} {die fresse|dein maul|das maul|die klappe}
verpiss dich
{fahr|geh} zur holle
{stirb|verreck|krepier} {endlich|doch|du}
{bring|hang} dich um
fick dich
{hijo|hija|hijos} de {puta|perra}
{basura|escoria} humana
al infierno
{cierra|cerra} {la boca|el pico}
{muerete|matate|pudrete}
{vete|iros} {a la mierda|al carajo}
que te {jodan|follen|den}
去死
不得好死
狗嘴
滚蛋
滚出去
滚回去
滚开
闭嘴
闭上你的嘴
下地狱
死了算了
"""
PHRASES = PHRASES.strip().split("\n")

# {name} in a pattern stands for one of these.
SETS = {
    "weak": "stupid|dumb|pathetic|disgusting|filthy|worthless|brainless|ugly|useless|rotten|vile|repulsive|ignorant|miserable|mindless|spineless|lazy|fat|dirty|hideous|clueless|loser|losers|pig|pigs|scum|trash|garbage|rat|rats|worm|worms|creature|clown|cow|dog|dogs|freak|freaks|pervert|perverts|prick|pricks|crap|shit|filth|vermin|disgrace|nobody|failure|parasite|leech|animal|animals|monster|cockroach|ape|apes|monkey|monkeys",
    "base": "vermin|filth|scum|trash|garbage|parasites?|animals|subhumans?|(?:a )?disease|(?:a )?plague|(?:a )?cancer|rats|cockroaches|lice|pigs|dogs|apes|monkeys|savages|criminals|thieves|inferior|worthless|disgusting|stupid|dirty|lazy|retarded|dumb|brainless|pests?|leeches|dirt",
    "group": "(?:people|folks?|women|men|girls|immigrants|migrants|foreigners|refugees|muslims|jews|christians|hindus|arabs|africans|asians|blacks|whites|mexicans|gays|lesbians|gypsies|disabled|elderly|northerners|southerners|easterners|westerners|peasants|natives)(?: (?:of|from|with|like|in) (?:\\p{L}+ ){0,2}\\p{L}+)?|their kind",
    "you": "you|u|ya|youre|yall|you all|you two",
    "body": "fingers?|legs?|arms?|neck|bones?|jaw|face|skull|knees?|teeth|nose|head|hands?|throat|ribs",
    "harm": "kill|murder|stab|beat|strangle|rape|shoot|hurt|smash|burn|punch|choke|slaughter|gut|bury|destroy|hunt|find|slap|whip|hang|drown|gas|cut|break",
    "person": "you|u|him|her|them|me|your|the model|this model|that model|this girl|that girl|the girl|this woman|that woman|the woman|models|women|girls|his|everyone",
    "gruppe": "(?:frauen|manner|auslander|fluchtlinge|migranten|juden|muslime|schwarze|schwule|lesben|behinderte|alte|leute|menschen|deutschen|polen|turken|araber|russen|afrikaner|asiaten|fremden|fremde)",
    "grupo": "(?:los |las |esos |esas |estos |todos los |todas las )?(?:mujeres|hombres|inmigrantes|extranjeros|refugiados|negros|negras|judios|musulmanes|moros|gitanos|gays|maricones|viejos|viejas|gordos|gordas|pobres|chinos|indios|indias|latinos|africanos|discapacitados|invalidos|minusvalidos|ninas|chicas|gente|vecinos)(?: (?:de|del|con) \\p{L}+){0,2}|ellos|ellas",
    "群": "(?:(?:人|女人|男人|女的|男的|妇女|同性恋|难民|移民|穆斯林|黑人|老人|胖子|穷人|乡巴佬|残疾人)|他们|她们|这些人|这种人|这帮人|那帮人|你们)",
}


# Patterns over the folded text, by concept; ``_`` stands for a space at either end, ``~`` for up to two words between.
DEMEANING = r"""
_(?:world|earth|everyone|we)(?: \p{L}+){0,3} better(?: off)? (?:without|before) (?:you|{group})_
_what (?:a|an) ~(?:{weak}) (?:you|he|she|they) (?:are|is)_
_only (?:a|an) ~(?:{weak}) (?:would|could|can)_
_(?:listen|hey|oi|shut up)(?: you)? (?:{weak})_
_(?:nobody|no one|noone) (?:~)(?:likes|wants|needs|loves|would miss|will miss|cares about|asked for) (?:you|your)(?: (?:(?:stupid|brainless|dumb|worthless|pathetic|ugly) )?(?:opinion|face|kind|here))?_
_you (?:were|are) (?:a mistake|better off dead|born a mistake|not even human)_
_(?:make|makes) me (?:want to )?(?:spit|puke|vomit|throw up|sick|gag)_
_(?:du|ihr)(?: (?:bist|seid|bleibst))?(?: (?:so|echt|ein|eine|nur|wirklich|doch|ganz|verdammter|verdammte|dreckiger))* (?:dumm|dumme|dummer|blod|bloder|blode|hasslich|ekelhaft|widerlich|wertlos|nutzlos|erbarmlich|schwein|schweine|sau|abschaum|dreck|mull|versager|ratte|ungeziefer|affe|parasit|opfer|lappen)_
_(?:verdienen|verdient)(?: es)? nicht zu leben_
_(?:eres|sois|tu|estas)(?: (?:un|una|unos|tan|muy|solo|de|lo|mas|verdadero|pedazo|puro|pura))* (?:estupid[oa]s?|tont[oa]s?|fe[oa]s?|basura|inutil|inutiles|cerd[oa]s?|perr[oa]s?|rata|escoria|asco|asqueros[oa]s?|parasito|mierda|patetic[oa]s?|animal|gusano|fracasad[oa]s?)_
_nadie te (?:quiere|soporta|extranaria|echaria de menos|lloraria)_
(?:你|妳|您)们?(?:真|就|全|都)?(?:是|这|这个|个|这种|真是)*(?:蠢|笨|丑|垃圾|猪|狗|臭|恶心|没用|废|烂|贱|虫|变态)(?!.{0,3}(?:衣|货|色))
(?:你)?(?:爸妈|父母|爹妈|妈|家人).{0,6}(?:丢人|丢脸|后悔|生了个|瞎了眼)
_(?:you|u|ya) (?:\p{L}+ )?(?:belong|deserve to be) (?:in|on|under|at) (?:a|the) (?:\p{L}+ )?(?:gutter|garbage|dump|trash|sewer|street|bin|zoo)_
_(?:nobody|no one) (?:will|would) (?:ever )?(?:love|miss|want|cry for) (?:you|someone like you)_
"""

# As above, threats and wishes of harm.
THREATS = r"""
_(?:hope|wish|pray)(?: that)? (?:you|he|she|they|your \p{L}+) (?:all )?(?:die|dies|choke|chokes|rot|burn|suffer|bleed|drown|get cancer|get hit|get run over|get raped|never wake up|were dead|fall down|go blind|crash)_
_if you (?:just )?(?:stopped breathing|were dead|died|disappeared|never woke up)_
_i (?:will|ll|am going to|am gonna|m going to|gonna|shall|want to|would love to)(?: \p{L}+){0,5} (?:{harm}) (?:you|your (?:{body}|family|kids|children|face)|u|him|her|them)_
_(?:i know|know) where you (?:live|work|sleep|park)_
_come to your (?:house|home|place|work|door)(?: \p{L}+){0,2} and_
_(?:someone|somebody|they|one|i|we)(?: \p{L}+)? (?:should|ought to|needs to|must) (?:{harm}) (?:the model|her|him|you|them|these people|those people|the seller|the \p{L}+er)_
_(?:break|smash|cut|crush|rip)(?: off)? your (?:{body})_
_wenn du (?:nicht mehr|tot|weg|stirbst|sterben)_
_ich (?:\p{L}+ ){0,3}(?:schlag|schlage|bring|bringe|mach|mache|stech|steche|steck|finde|find|krieg|breche|brech|hau|haue|knall) (?:dich|dir|euch)_
_(?:schlag|schlage|bring|stech|mach|prugel) (?:dich|euch) (?:tot|um|ab|fertig|kaputt)_
_(?:si|ojala)(?: te)? (?:desaparecieras|desaparezcas|murieras|mueras|te mueras|te murieras)_
_(?:te|os) (?:voy|vamos) a (?:matar|partir|romper|pegar|reventar|encontrar|violar|rajar|quemar|hundir|dar)_
_(?:se )?donde (?:vives|trabajas)_
(?:你|妳|您)(?:活着|生下来|出生|怎么).{0,6}(?:浪费|多余|错误|去死|跳楼|跳下去|不死)
(?:你|妳)早(?:就)?(?:该|应该)(?:去)?(?:死|消失|自杀)
(?:打断|砍断|打折|敲碎|弄死|打死|砍死|捅死|杀了|掐死|整死|揍死|揍扁)(?:了)?(?:你|他|她)
(?:我)?知道你(?:住|在)(?:哪|什么)
_(?:hang|shoot|kill|drown|burn|poison|hurt) (?:you|your) ?(?:self|family|kids|children|dog|house|all)?_(?= *$|.{0,20}_(?:now|tonight|soon|one day|slowly))
_ich wei(?:s|ss|ß) wo (?:du|ihr) (?:wohn\p{L}*|arbeit\p{L}*|schlaf\p{L}*)_
_(?:geh|geht|los) (?:endlich )?sterben_
_do (?:us|everyone|the world|me|yourself) (?:all )?a favo(?:u)?r and (?:\p{L}+ ){0,2}(?:die|disappear|jump|drop dead|kill|hang|rot|vanish)_
_se donde (?:vives|trabajas|duermes)_
"""

# As above, contempt or calls for violence against groups of people.
AGAINST_GROUPS = r"""
_(?:{group}) (?:are|is)(?: (?:all|just|nothing|but|the|really|only|like))* (?:{base})_
_(?:they|those|them)(?: (?:are|re))?(?: (?:all|just|nothing|but|really|only))* (?:vermin|filth|scum|subhumans?|parasites|savages|cockroaches|lice|leeches)_
_they (?:do not|dont|don t) deserve to (?:live|breathe|exist)_
_(?:die|sie|solche)(?: leute)? (?:sind|gehoren)(?: (?:alle|nur|doch|wie|wirklich|nichts|als))* (?:ungeziefer|abschaum|parasiten|untermenschen|tiere|weggesperrt|vergast|erschossen|ausgerottet|eingesperrt|vernichtet|weg)_
_(?:{group}) (?:do not|dont|don t|should not|shouldn t|never) (?:deserve to|be allowed to|be able to|have the right to|have a right to)?(?: )?(?:live|breathe|exist|vote|breed|be born|be here)(?: \p{L}+)*_
_(?:{group}) (?:should|must|ought to|deserve to|have to|need to) (?:all )?(?:be|get)?(?: )?(?:wiped out|shot|killed|gassed|deported|exterminated|hanged|burned|burnt|locked up|caged|kept out|put down|sterilized|beaten|die|banned from|thrown out|whipped|drowned|removed from)_
_(?:lock|put|throw|keep|shut)(?: up)? (?:all )?(?:the )?(?:[^\W\d_]+ )?(?:them|{group}) (?:up |away )?(?:in|into|behind|out)(?: of)? (?:a |the )?(?:cage|cages|camp|camps|prison|bars|country|ovens|zoo)_
_(?:deport|exterminate|gas|hang|shoot|kill|sterilize) (?:all |every )?(?:the |of )?(?:[^\W\d_]+ )?(?:{group})_
_(?:{gruppe}) (?:sind|gehoren)(?: (?:alle|nur|doch|wie|eine|der|wirklich|nichts|als))* (?:seuche|ungeziefer|abschaum|parasiten|tiere|dreck|schweine|untermenschen|ratten|krebs|pest|mull|affen|kriminelle|weggesperrt|vergast|erschossen|ausgerottet|abgeschoben|eingesperrt|vernichtet|weg|raus|minderwertig|dumm)_
_kein recht (?:auf leben|zu leben|zu atmen)_
_(?:{grupo}) son (?:(?:una|unos|unas|todos|todas|solo|como|pura|puros) )*(?:plaga|animales|escoria|parasitos|basura|ratas|cerdos|cancer|delincuentes|subhumanos|inferiores|bestias|mierda|peste|enfermedad|estupidos)_
_no (?:merecen|merece|mereces|merecéis|tienen derecho a) (?:vivir|respirar|existir)_
_(?:hay que|deberian|habria que|deben) (?:echar|matar|encerrar|expulsar|exterminar|eliminar|quemar|fusilar|gasear) a_
{群}(?:就|都|全|全都|统统|真)?(?:是|像).{0,4}(?:寄生虫|毒瘤|畜生|垃圾|害虫|蛀虫|渣|劣等|猪|狗|病毒|祸害|贱)
{群}(?:就|都|全|全都|根本)?(?:不配|没资格|不该|没脸)(?:活|出生|进|呼吸|做人|当人)
{群}(?:就|都|全|全都|统统)?(?:该|应该|应当).{0,3}(?:死|杀|赶|关|灭绝|消失|枪毙|滚|阉)
(?:把)?{群}(?:都|全)?(?:赶出|关进|关起|赶走|灭)
(?:看见|看到|一见|见到){群}.{0,3}(?:恶心|想吐|来气)
_(?:{group}) (?:are|is)(?: (?:all|just|nothing|but|the|really|only|like|\p{L}+ and))* (?:vermin|filth|scum|subhumans?|parasites|savages|terrorists|rapists|animals)_
_(?:{group}) belong (?:in|behind|on) (?:the |a )?(?:kitchen|cage|cages|zoo|camp|camps|chains|gutter|jail|leash)_
_(?:we|they|someone|you) (?:should|must|ought to|need to|have to) (?:just |all )?(?:kill|shoot|gas|hang|exterminate|deport|sterilize|wipe out|burn) (?:them|these people|those people|all of them|every one of them|{group})_
_(?:{group}) (?:are|were|is|was|being) (?:ever )?(?:allowed|let) (?:to )?(?:live|exist|breathe|breed|vote|be born|in here|near us)_
_(?:exterminate|gas|lynch) (?:them|these people|those people|all of them)_
_(?:{gruppe}) (?:raus|geh(?:o|oe)ren (?:geschlagen|verboten))_
_(?:{gruppe})(?: \p{L}+)? das sind (?:alles|alle|nur|doch)(?: \p{L}+)? (?:verbrecher|kriminelle|parasiten|tiere|abschaum|dreck)_
_(?:{grupo}) son (?:\p{L}+ )?(?:ladrones|criminales|asquerosos|violadores|terroristas|vagos)(?: \p{L}+)?_
滚回(?:你们?的?|他们的?)?(?:国家|国|老家|乡下)
"""

# As above, sexually explicit talk and solicitation.
SEXUAL = r"""
_(?:{you})(?: (?:are|re|r|is))?(?: (?:such|just|all|nothing|but|a|an|so|really|the|bunch|of|most|absolute|complete|total|fucking|bloody|utter|little|old|and))* (?:{weak})_
_(?:want|wants|wanna|like|love|going|gonna|need|wish|dying)(?: to)? (?:fuck|bang|screw|lick|rape|finger) (?:{person})_
_fuck (?:{person})_
_(?:lick|licked|licks|sucked|suck|fingered|fucked|banged|groped|fondled) (?:{person})_
_(?:send|show|give|post|mail)(?: \p{L}+){0,3} (?:nudes?|naked|tits|pussy|boobs|cock|dick|ass)_
_touch (?:yourself|your (?:self|tits|body))_
_(?:looking|look|searching|up|ready) for (?:\p{L}+ )?(?:sex|hookups?|a fuck|a blowjob|a quickie)_
_(?:had|have|having|want|wants|free|hot|anal|oral|wild|paid|hard)(?: \p{L}+)? sex (?:in|on|with|tonight|now|chat|video|videos|cam)_
_(?:sex|fuck|hookup) tonight_
_(?:wet|tight|hot|shaved|dripping) (?:pussy|cunt|clit)_
_(?:jerk|jerked|jerking|jack|jacked|wank|wanked|rub one|get|got|gets)(?: myself)? off (?:to|on|over)_
_(?:got|get|gets|makes me|made me|feel) (?:so )?(?:horny|hard|wet) (?:for|from|looking|watching|over|at|seeing)_
_(?:will|wurde|mochte|wollte)(?: \p{L}+){0,4} (?:ficken|bumsen|vogeln|durchficken)_
_(?:suche|biete|will)(?: \p{L}+){0,2} sex_
_(?:schick|zeig|schickt|sende)(?: \p{L}+){0,2} (?:nackt\p{L}*|titten|muschi|brüste|bruste|arsch)_
_(?:macht|machen|bin)(?: \p{L}+)? (?:geil|feucht|notgeil)(?: auf| wenn|_)
_(?:me|te|nos) (?:pone|ponen|pones|puso) (?:muy )?(?:cachond[oa]s?|caliente|duro|dura|mojada)_
_(?:quiero|busco|vamos a|ofrezco|necesito)(?: \p{L}+)? (?:follar\p{L}*|sexo|coger|chupar\p{L}*|polvo)_
_(?:mandame|enviame|pasame|ensename|muestrame)(?: \p{L}+){0,3} (?:desnud[oa]s?|tetas|nudes|culo|coño|cono|polla)_
_sexo (?:esta noche|gratis|ahora|oral|anal)_
(?:看|搞|弄|撩)得我(?:都)?(?:硬|湿)|我(?:都)?硬了|我湿了
(?:想|要|好想)(?:操|艹|干|上|日|睡|肏)(?:死)?(?:你|她|他|模|女|这个)
全?脱(?:光|了|掉).{0,6}(?:摸|给我|镜头|拍|看)
(?:发|来|给|求|传)(?:我|点|几张|张|些)?.{0,4}(?:裸|果照|私密照|黄图|露点|奶|胸照)
(?:约|找|求)(?:炮|泡|人睡|一夜)
_(?:suck|lick|ride|stroke) (?:my|his|her|your) (?:big |hard |wet )?(?:dick|cock|balls|pussy|clit|tits)_
_(?:big|huge|hard|throbbing|wet|stiff|erect|tight) (?:cock|dick|boner|pussy|cunt|clit)_
_(?:made|make|makes|making) (?:her|him|me|you) (?:cum|come hard|squirt|orgasm|climax)_
_(?:strip|undress) (?:for me|naked|on camera|on cam|in front of)_
_(?:spy|hidden|secret) (?:cam|camera|video|videos|footage) (?:of|in|from) (?:the )?(?:girls|women|ladies|changing|shower|locker|toilet|bedroom)_
_(?:bend|bending) (?:you|her|him) over_
_(?:his|her|my|your) (?:cock|dick|pussy|tits|clit|nipples) (?:is|was|got|gets|went|grew|stood|goes) (?:so |all |rock )?(?:hard|wet|stiff|erect)_
_zieh dich aus_(?=.{0,40}_(?:fur mich|kamera|zeig|nackt))
"""

# Patterns by concept.
PATTERNS = {"demeaning": DEMEANING.split("\n"), "threat": THREATS.split("\n"), "group": AGAINST_GROUPS.split("\n"), "sexual": SEXUAL.split("\n")}
PATTERNS = {c: [p for p in ps if p] for c, ps in PATTERNS.items()}

# Weight of one hit by concept.
WEIGHTS = {"slur": 10.0, "threat": 10.0, "group": 10.0, "sexual": 9.0, "phrase": 8.0, "demeaning": 8.0, "insult": 7.0, "mild": 0.1}

# Words that only add up with others.
MILD = """
damn stupid crap shit hell sexy naked nude ugly pathetic disgusting loser pig filthy worthless brainless
scheisse dumm geil nackt
mierda estupido estupida desnudo inutil
蠢 恶心 性感 变态
""".split()

# Words that stand between others where letters are set apart.
JOINING = """
the a an is are was this that these those of to in on at and or but so such not no it he she they we my his her our their who what with for from all just
der die das ein eine ist sind war und oder so nicht er sie es wir mein dein auf von mit fur zu el la los las un una es son era y o no tan de del en con por para mi su
""".split()

# Words that a first letter and three signs may stand for, beside the insults.
MASKED = {"fuck", "shit"}

# Harmless phrases; a hit inside one does not count.
HARMLESS = """
idiot proof
idiot checked
cock feather
cock feathers
pig leather
moth vermin
vermin proof
dead pixels
kill switch
naked seam
nude shade
tono nude
hardcore
a prueba de idiotas
stupid enough
son of a bitch of a zip
性别
""".strip().split("\n")

# (cue, words): phrases after which up to so many words are only named, in rules, reports and lists of removed posts.
NAMED_AFTER = [
    ("comments with the word", 2),
    ("posts with the word", 2),
    ("with the word", 2),
    ("block list", 6),
    ("blocked words", 6),
    ("calls someone a", 2),
    ("calls someone an", 2),
    ("call someone a", 2),
    ("call anyone a", 2),
    ("call anyone an", 2),
    ("call people", 3),
    ("call someone an", 2),
    ("was called", 3),
    ("called someone", 3),
    ("replies about", 4),
    ("comments about", 4),
    ("posts about", 4),
    ("the guide lists", 6),
    ("guide lists", 6),
    ("mit dem wort", 2),
    ("wer andere", 2),
    ("wurde als", 2),
    ("sperrliste", 6),
    ("con la palabra", 3),
    ("llamar", 3),
    ("lista de bloqueo", 6),
    ("palabras bloqueadas", 6),
]

# (cue, words) of the same kind that come after what they name.
NAMED_BEFORE = [("as content to remove", 5), ("content to remove", 5), ("has to be reported", 3), ("have to be reported", 3), ("se denuncia", 6), ("wird gemeldet", 3), ("wurde gemeldet", 3)]

# (cue, characters) of the same kind in Chinese text, which has no word borders.
NAMED_AFTER_CJK = [("屏蔽词", 24), ("条带", 6), ("骂人", 6), ("规范第", 14), ("留言里的", 6)]

# Pinyin and look-alike characters that stand for one character of a Chinese word.
CJK_VARIANTS = {
    "脑": ("nao", "闹"), "滚": ("gun", "衮"), "炮": ("pao", "泡"), "爱": ("ai", "爰"), "操": ("cao", "艹", "草", "肏"), "逼": ("bi", "b", "比", "笔", "批"),
    "傻": ("sha", "煞", "沙", "啥"), "贱": ("jian", "溅", "见"), "死": ("si", "屎"), "裸": ("luo", "果", "倮"), "废": ("fei", "费", "肥"), "畜": ("chu", "蓄"),
    "蠢": ("chun", "春"), "白": ("bai",), "痴": ("chi", "吃"), "硬": ("ying",), "狗": ("gou",), "货": ("huo",), "黄": ("huang",), "片": ("pian",), "毒": ("du",), "瘤": ("liu", "留"),
    "蛋": ("dan", "旦"), "残": ("can",), "照": ("zhao",), "偷": ("tou",), "腿": ("tui",), "虫": ("chong",), "婊": ("biao", "表"), "杂": ("za",), "渣": ("zha",),
}

# Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ь": "b", "п": "n", "г": "r", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "σ": "o", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
}

# Digits that stand for letters within a word.
LEET = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "$": "s", "€": "e", "£": "l"}
