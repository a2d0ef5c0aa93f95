"""Words of abusive, hateful and sexual language in the eleven languages, for problem 8.

They serve moderation only: sentences get a mark for each kind they hold, which says of what category a labelled example
is and makes sentences with other words of a kind alike. Stems match the start of a word; phrases of spaceless scripts
match anywhere.
"""

from __future__ import annotations

# Fixed values. you: the person addressed; insult; threat (also orders to be silent and wishes of harm); group: groups of
# people; hate: what degrades or shuts out a group; sex; coarse: swear words that belong to no kind by themselves;
# about: words that speak of words, classes, methods or cells, where the kinds above are objects of study.
WORDS: dict[str, dict[str, str]] = {
    "en": {
        "you": "you your yours yourself u",
        "insult": "idiot* moron* imbecil* scumbag* bastard* asshole* arsehole* halfwit* dumbass* loser* jerk* bitch* prick* cunt* dickhead* pathetic worthless brainless stupid dumb retard* coward* clown* dimwit* nitwit* whore* slut* douchebag* motherfucker* pig",
        "threat": "kill* neck rot hell beat* beating strangle* stab* shoot* punch* smash* choke* you_die should_die must_die to_die regret shut_up break_your where_you watch_your go_to_hell",
        "group": "foreigner* immigrant* migrant* refugee* women woman men jew* muslim* christian* arab* black* gypsies gypsy gay* lesbian* disabled cripple* elderly old_people natives asian* african* mexican*",
        "hate": "vermin parasite* subhuman* filthy plague animals scum thrown_out throw_out wiped_out wipe_out exterminat* deport* thieves liar* inferior rats cockroach* not_human even_human go_back not_belong do_not_deserve",
        "sex": "porn* naked nude* sex sexy horny lick* moan* orgasm* blowjob* masturbat* tits pussy cock dick* erotic* undress* strip* breasts hardcore xxx cum",
        "coarse": "fuck* shit* damn* crap* bloody",
        "about": "word* comment* class classes classifier* filter* list* argument* evaluation paper* analysis process* children* queue terminal setup cell* tissue* age gender* figure* data definition* study term* method* detect* dictionary",
    },
    "de": {
        "you": "du dich dir dein* euch ihr",
        "insult": "idiot* vollidiot* schwachkopf* arschl* wichser* trottel* depp* blödmann* hurens* drecksk* penner* misst* elend* dumm* blöd* hirn* schlamp* mistkerl* spast* versager*",
        "threat": "fresse maul sterben verreck* umbring* schlag* prügel* töte* halt_die geh_sterben krepier* bring_dich",
        "group": "ausländer* frauen juden muslim* behindert* flüchtling* zigeuner* schwarze* schwule* migrant* männer türken",
        "hate": "ungeziefer* parasit* dreckig* minderwertig* abschaum* untermensch* gejagt küche vergas* lügner* diebe ausrott* raus_mit aus_dem_land keine_menschen abschieb* sperrt",
        "sex": "porno* nackt* geil* fick* sex* brüste titten schwanz muschi stöhn* blasen bumsen lecken",
        "coarse": "scheiß* scheiss* verdammt* kacke",
        "about": "wort wörter kommentar* klasse* filter* liste* argument* auswertung* unsinn alter geschlecht leser* prozess* zelle* gewebe* studie* begriff* methode*",
    },
    "fr": {
        "you": "tu te toi ton ta tes vous t",
        "insult": "connard* abruti* imbécile* crétin* salop* encul* débile* ordure* idiot* minable* pauvre_con sale_con gros_con petit_con bâtard* tocard* ducon pute* sale",
        "threat": "gueule casse* crève* foutre figure tue* tuer ferme fais_foutre je_te retrouve* tabass*",
        "group": "étranger* femmes juifs musulman* arabes noirs handicapé* immigré* vieux homosexuel* migrants gitans",
        "hate": "vermine* parasite* dehors sous-homme* voleur* menteur* inférieur* bêtes cuisine extermin* jette* chass* pas_des êtres_humains expuls* racaille",
        "sex": "porno* nue nues nus baiser baise* chaleur sexe* bite chatte jouir sucer seins déshabill* coquin* coucher",
        "coarse": "merde* putain foutu* chier",
        "about": "mot mots commentaire* classe* filtre* liste* argument* évaluation* âge genre lecteurs cellule* tissu* étude* terme* méthode* apparaît",
    },
    "es": {
        "you": "tú tu te ti eres tus vos",
        "insult": "imbécil* gilipoll* idiota* cabrón* cabrones estúpid* inútil* pendej* basura hijo_de puta* tont* capull* payas* zorra*",
        "threat": "cállate callate pudras mato matar romper* muérete vete ojalá partir* golpe*",
        "group": "extranjer* inmigrant* mujeres judí* musulman* negros gitan* discapacitad* viejos ancianos moros",
        "hate": "plaga* parásit* echarl* escoria* ladron* mentiros* suci* inferior* cocina extermin* merecen_vivir no_merecen no_son_humanos expuls* ratas",
        "sex": "porno* desnud* foll* caliente* sexo polla coño tetas chupar gemir correrse cama cachond*",
        "coarse": "mierda* joder coño hostia",
        "about": "palabra* comentario* clase* filtro* lista* argumento* evaluación edad género lectores célula* tejido* estudio* término* método* aparece",
    },
    "pt": {
        "you": "tu te ti você teu tua és",
        "insult": "imbecil idiota* cabrão estúpid* inútil otári* burro* lixo filho_da puta* parvo* palerma* desgraçad*",
        "threat": "cala_a cala-te mato morre matar foder apodre* parto vai_à boca",
        "group": "estrangeir* imigrant* mulheres judeus muçulman* negros cigan* deficientes velhos idosos",
        "hate": "praga* parasita* expuls* escória* ladrõ* mentiros* imund* inferior* cozinha extermin* merecem_viver não_merecem não_são_humanos",
        "sex": "porno* pornô nua nuas nudes foder fod* tesão sexo buceta mamas gemer chupar cama pelad* transar",
        "coarse": "merda* caralho porra",
        "about": "palavra* comentário* classe* filtro* lista* argumento* avaliação idade género gênero leitores célula* tecido* estudo* termo* aparece",
    },
    "it": {
        "you": "tu te ti tuo tua sei tuoi",
        "insult": "idiota* imbecill* stronz* coglion* bastard* deficient* cretin* spazzatura inutile testa_di puttan* scem* fallit*",
        "threat": "zitto vaffanculo crepa ammazz* spacco muori uccid* marcisci faccia",
        "group": "stranier* immigrat* donne ebrei musulman* neri zingar* disabili vecchi omosessuali",
        "hate": "feccia parassit* cacciar* peste ladri bugiard* sporc* inferior* cucina stermin* meritano_di_vivere non_meritano non_sono_umani fuori_dal",
        "sex": "porno* nuda nude scop* sesso cazzo figa tette gemer* leccar* eccitat* letto spogli*",
        "coarse": "merda* cazzo porca",
        "about": "parola parole comment* classe* filtro* lista* argoment* valutazione età genere lettori cellul* tessut* studi* termin* compare",
    },
    "ru": {
        "you": "ты тебя тебе твой твоя твои тобой вы",
        "insult": "идиот* придур* тварь твари урод* мразь сволоч* дебил* ублюд* кретин* мудак* жалк* тупой тупая дурак* дура козёл козел* скотин* шлюх*",
        "threat": "заткнись сдох* прибью убью найду пошёл пошел убей* морд* сгни* башк*",
        "group": "приезж* мигрант* женщин* евре* мусульман* чёрн* инвалид* старик* иностран* цыган* понаехавш*",
        "hate": "паразит* вышвырн* недочелов* грязн* воры лгун* уничтож* выгнать гнать не_люди от_рождения из_страны нечего_делать тупые",
        "sex": "порно* голы* голая голую трах* секс* хочу_тебя минет сиськ* стон* интим* раздев* эротик*",
        "coarse": "дерьм* хрен* блядь бля говн*",
        "about": "слово слова комментар* класс* фильтр* список* довод* оценк* возраст* пол читател* клетк* ткан* исследован* термин* метод* встречается",
    },
    "zh": {
        "you": "你 妳 你们 你們",
        "insult": "白痴 白癡 蠢货 蠢貨 废物 廢物 混蛋 傻逼 傻瓜 贱人 賤人 王八蛋 脑残 腦殘 笨蛋 畜生",
        "threat": "闭嘴 閉嘴 去死 滚出去 滾出去 打断 打斷 杀了你 殺了你 打死 弄死",
        "group": "外国人 外國人 外地人 女人 移民 犹太人 猶太人 黑人 残疾人 殘疾人 老人",
        "hate": "不算人 不是人 早该死 早該死 赶出去 趕出去 寄生虫 寄生蟲 害虫 害蟲 天生就 不配 滚回 滾回 消灭 消滅 小偷 骗子 騙子 都是垃圾 垃圾",
        "sex": "黄片 黃片 裸照 做爱 做愛 上床 色情片 性交 脱光 脫光 呻吟 成人视频 成人影片 乳房 裸体 裸體",
        "coarse": "他妈的 他媽的 操你 妈的 狗屁",
        "about": "这个词 這個詞 一词 一詞 评论里 評論裡 出现过 出現過 年龄 年齡 性别 性別 分类 分類 类别 類別 论文 論文 评估 評估 细胞 細胞 组织 組織 研究 过滤 過濾",
    },
    "ja": {
        "you": "お前 おまえ あなた 君 きみ てめえ 貴様",
        "insult": "バカ 馬鹿 クズ アホ 間抜け 能無し カス 無能 ブス",
        "threat": "死ね 黙れ 消えろ くたばれ 殺す ぶっ殺 殴る 殴って",
        "group": "外国人 移民 女は 女ども 障害者 老人 在日 連中",
        "hate": "害虫 寄生虫 追い出せ 人間じゃない 人間ではない 劣って 出て行け 生きる価値 泥棒 根絶やし ゴミ",
        "sex": "エロ ポルノ 裸 セックス ヤりたい 無修正 喘ぐ おっぱい 抱きたい アダルト動画",
        "coarse": "クソ くそ 畜生",
        "about": "という語 という言葉 単語 コメント 分類 論文 評価 年齢 性別 細胞 組織 研究 フィルタ",
    },
    "ko": {
        "you": "너는 네가 너 당신 니가 너를",
        "insult": "멍청이 바보 병신 새끼 개새끼 한심한 얼간이 등신 머저리",
        "threat": "닥쳐 꺼져 죽어 죽여 패버 뒈져 때려",
        "group": "외국인 이민자 여자들 여자는 장애인 노인 난민",
        "hate": "해충 기생충 쫓아내 사람도 열등 더러운 도둑 살 가치 몰아내 쓰레기",
        "sex": "야동 포르노 알몸 누드 섹스 벗은 자고 싶 신음 야한",
        "coarse": "씨발 젠장 제기랄",
        "about": "단어 댓글 분류 논문 평가 나이 성별 세포 조직 연구 필터",
    },
}

# Frequent words, to tell in which language a sentence is.
COMMON: dict[str, str] = {
    "en": "the of and to in is are that for with this was were by on as it be at from or an have has not which they he she what who if all so i me my we our its been their there no a into should would could can will you your do don up out about more than only when just them us him any all these those",
    "de": "du dich dir ihr in zum zur sich man wenn alle so was der die das und ist nicht ein eine einen mit für von zu auf dem den des im am wir sie er es aus bei nur auch wie oder als so haben hat wurde werden sind ich bin noch",
    "fr": "le la les de à j ai te moi toi c n m y en si tout tous plus être fait des et est une un dans pour que qui ne pas du au aux ce cette nous vous il elle ils sont sur avec par ou plus se son sa ses mais je on d l qu",
    "es": "a tú tu eres este esta él ella yo si te el la los las y es una un de en que por con para no se del al lo su sus como más pero nos le son está fue ha hay muy todos todo te me ya",
    "pt": "de tu teu se tudo este esta ela o a os as e é um uma de em que por com para não se do da dos das no na ao à mais mas são está foi há nos eu todos te me já muito",
    "it": "a tu tuo se tutto tutti questo questa il lo la i gli le e è un una di in che per con non si del della dei delle al alla nel sono più ma come da ha hanno ti mi tutti già molto",
    "ru": "и в не на с что по из у к за от как для это мы они он она все но или же бы так был была было его их я со о а",
}
