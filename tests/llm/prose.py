"""Clean prose of 50 words and more in languages and scripts that the quality rules list."""

from __future__ import annotations

PROSE = {
    "en": "The harbour was quiet that morning, and the fishermen had already pulled their boats onto the sand before the first visitors came down from the hotel. A woman sold warm bread and coffee from a small cart near the wall. Children ran along the pier while their parents looked for a place in the shade, and somewhere behind the church a bell began to ring slowly.",
    "de": "Am frühen Morgen war der Markt noch leer, nur zwei Händler stellten ihre Tische auf und sprachen leise über das Wetter. Später kamen die ersten Kunden, kauften Brot, Käse und Äpfel und blieben lange stehen, weil jeder etwas zu erzählen hatte. Gegen Mittag begann es zu regnen, doch niemand wollte gehen, denn unter den großen Schirmen war es warm und gemütlich.",
    "fr": "Le matin, la petite place du village reste calme, et les volets des maisons sont encore fermés quand le boulanger ouvre sa porte. Une odeur de pain chaud se répand dans la rue, puis les enfants passent en riant avant l'école. Vers midi, les terrasses se remplissent peu à peu, chacun raconte sa semaine, et le vieux facteur s'arrête toujours pour boire un café.",
    "es": "Por la mañana el mercado se llena de gente que busca fruta fresca, pescado y flores para la casa. Los vendedores gritan los precios, bromean con los clientes y regalan a los niños un trozo de naranja. Después del mediodía las calles quedan vacías, porque todos descansan un poco antes de volver al trabajo, y sólo se oye el ruido lejano de una radio.",
    "it": "La mattina presto il treno attraversa la pianura coperta di nebbia, e i viaggiatori guardano fuori senza parlare. Una ragazza legge un libro, un vecchio dorme con il cappello sugli occhi, due studenti ripassano gli appunti prima dell'esame. Quando il sole finalmente appare dietro le colline, tutti sorridono, come se la giornata fosse cominciata soltanto adesso e non molte ore prima.",
    "el": "Το πρωί η θάλασσα ήταν ήσυχη και οι ψαράδες γύριζαν αργά στο λιμάνι με τις βάρκες γεμάτες. Μια γυναίκα άπλωνε τα ρούχα στην αυλή, ενώ τα παιδιά έτρεχαν προς το σχολείο γελώντας. Στο καφενείο οι γέροι συζητούσαν για τον καιρό και για τα παλιά χρόνια, όταν το νησί είχε ακόμη πολλούς κατοίκους και κάθε βράδυ ακουγόταν μουσική από τα σπίτια κοντά στην πλατεία.",
    "ru": "Утром в городе выпал первый снег, и дворники уже чистили дорожки возле старого парка. Дети радостно бежали в школу, бросали снежки и громко смеялись, а взрослые спешили на работу, пряча лица в тёплые шарфы. К вечеру мороз усилился, на окнах появились узоры, и бабушка поставила самовар, чтобы вся семья могла согреться чаем с вареньем и спокойно поговорить о прошедшем дне.",
    "ko": "오늘 아침 에는 비가 조금 내렸지만 점심 무렵부터 하늘이 맑아졌다. 시장에는 과일과 생선을 사려는 사람들이 많았고, 상인들은 큰 소리로 손님을 불렀다. 나는 오래된 친구를 만나 작은 찻집에서 이야기를 나누었다. 우리는 학교에 다니던 시절을 떠올리며 웃었고, 다음 달에 바다로 여행을 가기로 약속했다. 집으로 돌아오는 길에 꽃 한 다발을 사서 어머니께 드렸더니 무척 기뻐하셨다. 저녁에는 가족 모두가 함께 밥을 먹었다.",
    "zh": "今天 早上 下 了 一 场 小雨 , 中午 以后 天空 慢慢 变得 晴朗 。 市场 里 有 很多 人 买 水果 和 鲜鱼 , 老板 大声 招呼 客人 。 我 和 老朋友 在 茶馆 里 聊天 , 说起 以前 上学 的 日子 , 大家 都 笑 了 。 我们 约好 下个月 一起 去 海边 旅行 。 回家 的 路上 , 我 买 了 一束 花 送给 母亲 , 她 非常 高兴 。",
    "ja": "今朝 は 少し 雨 が 降った が 、 昼ごろ から 空 が 晴れて きた 。 市場 に は 果物 や 魚 を 買う 人 が 多く 、 店 の 主人 は 大きな 声 で 客 を 呼んで いた 。 私 は 古い 友達 に 会い 、 小さな 喫茶店 で 話 を した 。 帰り道 に 花 を 買って 母 に 渡す と 、 とても 喜んで くれた 。",
    "ar": "في الصباح كان السوق هادئا والباعة يرتبون الفواكه والخضار قبل وصول الناس. جلس رجل عجوز قرب الباب يشرب الشاي ويتحدث مع جاره عن المطر الذي نزل في الليل. بعد الظهر امتلأت الشوارع بالأطفال العائدين من المدرسة، وارتفعت أصواتهم وهم يضحكون ويلعبون. وعندما غابت الشمس عاد كل واحد إلى بيته، وبقي ضوء صغير في نافذة المكتبة القديمة حيث كانت فتاة تقرأ كتابا طويلا.",
    "hi": "सुबह के समय गाँव का बाज़ार शांत था और दुकानदार अपनी दुकानें खोल रहे थे। एक बूढ़ा आदमी पेड़ के नीचे बैठकर चाय पी रहा था और अपने पड़ोसी से मौसम की बातें कर रहा था। दोपहर के बाद बच्चे स्कूल से लौटे और मैदान में खेलने लगे। शाम को जब सूरज डूब गया तो सब लोग अपने घर चले गए और माँ ने गरम खाना बनाया।",
    "he": "בבוקר היה השוק שקט והמוכרים סידרו את הפירות והירקות לפני שהגיעו האנשים. איש זקן ישב ליד הדלת, שתה תה ודיבר עם שכנו על הגשם שירד בלילה. אחר הצהריים התמלאו הרחובות בילדים שחזרו מבית הספר, וקולות הצחוק שלהם נשמעו מרחוק. כאשר השמש שקעה חזר כל אחד אל ביתו, ורק אור קטן נשאר בחלון הספרייה הישנה, שבה ישבה נערה וקראה ספר ארוך מאוד.",
    "th": "ตอน เช้า ตลาด ยัง เงียบ และ พ่อค้า กำลัง จัด ผลไม้ กับ ผัก ก่อน ที่ ผู้คน จะ มา ถึง ชาย ชรา คน หนึ่ง นั่ง ใกล้ ประตู ดื่ม ชา และ คุย กับ เพื่อนบ้าน เรื่อง ฝน ที่ ตก เมื่อ คืน หลัง เที่ยง ถนน เต็ม ไป ด้วย เด็ก ที่ กลับ จาก โรงเรียน เสียง หัวเราะ ดัง ไป ไกล เมื่อ ดวงอาทิตย์ ตก ทุก คน ก็ กลับ บ้าน",
    "ka": "დილით ბაზარი მშვიდი იყო და გამყიდველები ხილს ალაგებდნენ სანამ ხალხი მოვიდოდა. მოხუცი კაცი კართან იჯდა, ჩაის სვამდა და მეზობელს ღამის წვიმაზე ელაპარაკებოდა. შუადღის შემდეგ ქუჩები ბავშვებით აივსო, რომლებიც სკოლიდან ბრუნდებოდნენ და ხმამაღლა იცინოდნენ. როცა მზე ჩავიდა, ყველა თავის სახლში დაბრუნდა და მხოლოდ ძველი ბიბლიოთეკის ფანჯარაში დარჩა პატარა სინათლე, სადაც გოგონა დიდხანს კითხულობდა გრძელ წიგნს ზღვაზე და მთებზე, ხოლო მისი ძმა წერილს წერდა.",
}
