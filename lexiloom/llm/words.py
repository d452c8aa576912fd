"""Word lists."""

from __future__ import annotations

#: Frequent short words by language.
COMMON = {
    "fr": """a à ai ainsi alors au aucun aucune aujourd aussi autre autres aux avec bien ce cela celle celui ces cette chaque chez comme comment d dans de depuis des
deux donc du elle elles en encore entre est et été être eux fait faut il ils j je jour jours l là la le les leur leurs lui ma mais même
mes mieux moins mon n ne ni nos notre nous on ont ou où par parfois pas peu peut plus pour pourquoi pourtant puis qu quand que quel quelle
qui quoi rien s sa sans se ses si sont sous souvent sur t ta tandis te toujours tous tout toute très trop tu un une vers vos votre vous y c m voici voilà oui non près loin autour côté bord milieu face travers cette depuis""".split(),
    "en": """a about after all also always an and any are as at be because been before beside but by can could did do does doesn every for from had has have he her his how i if in into is it its
knows more most my no nobody not now of on one only or other our out over said she so some such tell than that the their them then there these they this those to
under up was we were what when where which while who whom why will with would write you your beside behind near below beyond around across above between near meanwhile however""".split(),
    "de": """aber als am an auch auf aus bei beim bis bitte da das dass dem den denn der des die dies diese doch du durch ein eine einem einen einer eines er es für gegen hat ich
ihr im in ins ist ja jahr jeden kein keine man mehr mit nach nicht nichts niemand noch nur ob oder ohne sehr sein sich sie sind so über um und uns unter vom von
vor war warum was weiß wenn wer werden wie wird wir wo zu zum zur zwischen hinter neben vor während trotz seit""".split(),
    "es": """a al algo algunas algunos ante antes así aunque cada como con contra cuál cuando cuya de del desde donde durante e él el ella en entre era es ese eso esta está este fue ha hasta hay la
las le lo los más mi mientras muy nada ni no nos o otra otro para pero por porque puede que qué quién se según ser si sí sin sobre su sus también tan tiene todavía todo tras tu un una uno unos varias varios y ya cerca lejos alrededor detrás delante debajo encima junto lado través después mientras""".split(),
    "pt": """a ao aos até com como da das de do dos e é ela ele em entre essa esse está foi há isso já mais mas muito na não nas no nos numa o os ou para pela pelo por quando que quem são se sem seu sua também tem um uma""".split(),
    "it": """a al alla anche che chi ci come con cui da dal del della delle di dove e è gli ha i il in io la le lo loro ma mi nel nella non per perché più quando quello se si sono su un una uno vi""".split(),
    "nl": """aan als alle alleen altijd andere bij dan dat de deze die dit door een en er geen haar had heb heeft het hij hoe hun iets ik in is jaar je kan kunnen maar me meer met mijn na naar niet nog nu of om omdat onder ook op over te tegen tot tussen uit van veel voor waar wanneer was wat we wel werd wie wij worden wordt zal ze zijn zo zonder zou""".split(),
    "pl": """ale bardzo bez bo by był była było być ci co czy dla do gdy gdzie go i ich ile im ja jak jako jego jej jest już każdy kiedy kto który która które lub ma mi może na nad nie nic o od on ona oni po pod przez przy się są ta tak także tam te tego ten to tylko tym w we więc wszystko z za ze że""".split(),
    "sv": """alla att av bara blev bli blir de dem den denna det detta där efter eller en ett finns från får för genom ha hade han har hon hur i inte jag kan kunde man med men mellan mot mycket ner nu när och om på sedan sig sin ska skulle som så till under upp ut utan var vad vara vi vid vill är än över""".split(),
    "da": """af alle andre at blev bliver da de dem den denne der deres det dette efter eller en er et for fra få ham han har havde hun hvad hvor ikke ind jeg jo kan kun kunne man med meget men mellem mod ned nu når og også om op over på sig sin skal skulle som til ud uden under var ved vil være""".split(),
    "ro": """a acest această ai al ale am ar are au ca care cât ce cel cele cu când de decât deci din doar după ea ei el este eu fără fi fost iar în la le lor lui mai mult ne nici nu o pe pentru prin sau să se si sunt și tot un una unde unei unui""".split(),
    "cs": """aby ale ani až bez bude by byl byla bylo být co do ho i jak jako je jeho její jen ještě již jsem jsou k kde kdo když která které který má mezi na nad ne nebo není o od po pod podle pro proto před při s se si sou ta tak také tato ten to tu u v ve více však z za ze že""".split(),
    "tr": """ama ancak bana ben bir biri biz bu bunu çok çünkü da daha de değil diye en gibi hem hep her hiç için ile ise kadar ki kim mı mi ne neden o olan olarak onu oldu olduğu sadece sen siz şey şu sonra tüm üzere var ve veya ya yok""".split(),
}
