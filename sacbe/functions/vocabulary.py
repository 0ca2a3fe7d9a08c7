"""Word lists and labels that results depend on (fixed values)."""

SUBJECTS = ("matematicas", "ciencias_naturales", "ciencias_sociales", "comunicacion_lenguaje", "ingles", "otro")
LEVELS = ("primaria_baja", "primaria_alta", "basicos")
SUBJECT_NAMES = {"matematicas": "Matemáticas", "ciencias_naturales": "Ciencias Naturales", "ciencias_sociales": "Ciencias Sociales", "comunicacion_lenguaje": "Comunicación y Lenguaje", "ingles": "Inglés", "otro": "General"}
LEVEL_NAMES = {"primaria_baja": "Primaria baja", "primaria_alta": "Primaria alta", "basicos": "Ciclo básico"}

# Words counted per subject.
LEXICON = {
    "matematicas": "número numero ecuación ecuacion suma resta multiplicación multiplicacion división division geometría geometria fracción fraccion problema triángulo triangulo área area perímetro perimetro decimal álgebra algebra operación operacion".split(),
    "ciencias_naturales": "célula celula energía energia planta experimento cuerpo materia animal ecosistema átomo atomo fuerza organismo digestión digestion fotosíntesis fotosintesis mezcla temperatura sistema salud".split(),
    "ciencias_sociales": "historia mapa cultura gobierno fecha comunidad guatemala población poblacion territorio municipio independencia constitución constitucion sociedad economía economia derechos ciudadano maya colonial".split(),
    "comunicacion_lenguaje": "lectura gramática gramatica verbo sustantivo poema cuento ortografía ortografia adjetivo oración oracion sílaba silaba acento narrador personaje texto escritura sinónimo sinonimo párrafo parrafo".split(),
}

# Stop words of the language shares.
STOP_ENGLISH = "the and you your with this that have for are what they from will can about there their which would these when been some".split()
STOP_SPANISH = "el la los las de que y en un una es por con para se del al lo como más mas pero sus le ya o este esta son entre".split()

# Stop words of the study terms, without accents.
STOP_STUDY = """
a al algo alguna algunas alguno algunos ante antes aqui aquel aquella aquellas aquello aquellos asi aun aunque cada casi como con contra cual cuales cuando cuanto de del
desde donde dos durante e el ella ellas ello ellos en entre era erais eran eras eres es esa esas ese eso esos esta estaba estaban estamos estan estar estas este esto estos
estoy fue fueron fui ha habia habian han has hasta hay he la las le les lo los luego mas me mi mia mias mientras mio mios mis mucha muchas mucho muchos muy nada ni no nos
nosotros nuestra nuestras nuestro nuestros nunca o os otra otras otro otros para pero poco pocos por porque pues que quien quienes se sea sean segun ser si sido siempre sin
sobre solo son soy su sus suya suyas suyo suyos tal tambien tampoco tan tanto te tener ti tiene tienen toda todas todo todos tu tus un una unas uno unos usted ustedes vez ya
yo vosotros vuestra vuestro dijo dije dice decir habia hacer hace hacia hecho tenia puede pueden podia podian debe deben entonces despues ahora bien bueno buena asi ahi
alli aca alla cosa cosas manera modo forma parte veces vez dia dias año años tiempo mismo misma mismos mismas otro otra tras ademas donde cuando mientras ano anos
tengo tienes tenemos tienen tenian voy vas va van vamos iba iban puedo puedes podemos quiero quieres quiere quieren queria querian sabes sabe saben sabia veo ves vemos vio
vieron hago haces hacen hizo hicieron creo crees cree nadie alguien demasiado bastante jamas aquello acaso quizas tal vez pronto tarde temprano respondio pregunto exclamo
anadio contesto replico murmuro grito repitio prosiguio continuo observo
uno dos tres cuatro cinco seis siete ocho nueve diez veinte cien mil millones primera primero segundo segunda tercero tercera ultimo ultima
""".split()

# Labels of school books that announce and are no terms, without accents.
LABEL_WORDS = """
importante nota recuerda recuerdo observa observo ejemplo ejemplos atencion actividad actividades pista consejo aprendo aprendemos glosario resumen conclusion conclusiones
respuesta respuestas solucion pregunta preguntas reflexiono reflexionamos sabias que dato curioso para saber mas tarea instrucciones
""".split()
