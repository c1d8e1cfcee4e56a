"""Fixed values of the gold KPI tables: name, unit, description, category.

These strings must equal the reference dashboards' so a user's dashboards
keep working; they are listed plainly, in the reference's order, one
table per dashboard. ``{region}`` marks per-region rows. ``key`` is the
surrogate-key stem used by the executive table's ``kpi_id``.
"""

# Fixed values — executive dashboard: (key, name, unit, description, category)
EXECUTIVE = [
    ("habitat_score", "Habitat Intelligence Score", "score",
     "Weighted composite: IR impact (30%) + supply pressure (35%) + GDP/capita (35%)", "composite"),
    ("gdp_per_capita", "GDP per Capita YoY", "%", "Gross domestic product per capita, year-over-year change", "economic"),
    ("ir_stability", "Interest Rate Stability", "index", "100 minus interest rate volatility score", "monetary"),
    ("tourism_link", "Tourism-Economy Link", "index", "Tourism impact on housing market", "tourism"),
    ("supply_pressure", "Housing Supply Pressure", "score",
     "Supply deficit feature from building consents vs population", "supply"),
    ("rent_gap", "Rent Affordability Gap", "ratio", "Rent-to-income ratio indicating affordability gap", "affordability"),
    ("ocr", "Current OCR", "%", "Reserve Bank Official Cash Rate", "monetary"),
    ("cpi", "Inflation (CPI)", "%", "Consumer price index annual change", "inflation"),
    ("building_consents", "Building Consents (Annual)", "count", "Total building consents issued", "supply"),
]

# Fixed values — housing dashboard: (name, unit, description, category)
HOUSING = [
    ("Median House Price - {region}", "NZD", "Consent-based price proxy (consents x 150) for {region}", "price"),
    ("Housing Supply Deficit Score", "score", "National housing supply deficit", "supply"),
    ("Building Consents - {region}", "count", "Annual building consents for {region}", "supply"),
    ("Population Growth - {region}", "%", "Population growth for {region}", "demographics"),
    ("National Median Weekly Rent", "NZD", "National median weekly rent", "rental"),
    ("National Rent-to-Income Ratio", "%", "National average rent-to-income ratio", "affordability"),
    ("Estimated Days on Market", "days", "Estimated days on market from supply pressure", "market"),
]

# Fixed values — tourism dashboard
TOURISM = [
    ("Tourism Pressure Index", "index", "Overall tourism pressure on housing market", "pressure"),
    ("Visitor Arrivals (Annual)", "thousands", "Total international visitor arrivals", "volume"),
    ("Tourism Expenditure (Annual)", "NZD millions", "Total regional tourism expenditure", "economic"),
    ("Tourism to Rent Lag", "index", "Average lag between tourism growth and rent changes", "lag"),
    ("Visitor Seasonality Strength", "ratio", "Peak to low visitor ratio", "seasonality"),
    ("Tourism-Housing Market Link", "%", "Year-over-year change in tourism pressure on housing", "correlation"),
]

# Fixed values — macro dashboard
MACRO = [
    ("Current OCR", "%", "Reserve Bank Official Cash Rate", "monetary"),
    ("OCR vs 10-Year Average", "percentage points", "Current OCR minus 10-year historical average", "monetary"),
    ("Mortgage Rate (2Y Fixed)", "%", "Average 2-year fixed mortgage rate", "mortgage"),
    ("Monthly Mortgage Cost ($750k loan)", "NZD", "Estimated monthly payment on $750k at current 2Y rate", "mortgage"),
    ("GDP Growth YoY", "%", "Gross domestic product growth year-over-year", "economic"),
    ("GDP Per Capita", "NZD", "Gross domestic product per capita", "economic"),
    ("OCR Change (bps)", "bps", "OCR change in basis points", "monetary"),
    ("Interest Rate Volatility", "index", "Interest rate volatility composite", "volatility"),
    ("Economic Confidence Index", "index",
     "Composite economic confidence from GDP stability and rate volatility", "composite"),
    ("Visitor Arrivals (Annual)", "thousands", "Total international visitor arrivals", "tourism"),
]

# Fixed values — affordability dashboard
AFFORDABILITY = [
    ("Years to Buy - {region}", "years", "Estimated years of median income to buy median home in {region}", "purchase"),
    ("Rent Burden - {region}", "%", "Rent as percentage of median income in {region}", "rental"),
    ("Median Weekly Rent - {region}", "NZD", "Median weekly rent in {region}", "rental"),
    ("National Affordability Index", "index", "National housing affordability composite index", "composite"),
    ("National Price-to-Income Ratio", "ratio", "National average price-to-income ratio", "purchase"),
    ("National Rent Burden", "%", "National average rent as percentage of income", "rental"),
    ("Affordability Erosion Rate", "%", "Rate at which affordability is declining due to rent inflation", "trend"),
]

# Fixed values — forecast dashboard
FORECAST = [
    ("12-Month Price Forecast", "NZD", "Projected median price with 3% annual growth", "forecast"),
    ("Forecast Growth (%)", "%", "Year-over-year projected growth", "growth"),
    ("Confidence Interval (80% Upper)", "NZD", "Upper bound of 80% confidence interval", "confidence"),
    ("Confidence Interval (80% Lower)", "NZD", "Lower bound of 80% confidence interval", "confidence"),
    ("Confidence Interval (95% Upper)", "NZD", "Upper bound of 95% confidence interval", "confidence"),
    ("Confidence Interval (95% Lower)", "NZD", "Lower bound of 95% confidence interval", "confidence"),
    ("Model Confidence Score", "/100", "Forecast model confidence based on rate stability", "confidence"),
    ("OCR +0.5% Price Impact", "NZD", "Estimated price impact if OCR increases 0.5%", "scenario"),
    ("Tourism +20% DOM Impact", "index", "Estimated DOM impact if tourism increases 20%", "scenario"),
    ("Divergence Alert Score", "%", "Divergence between forecast and actual trend", "alert"),
    ("Trend Direction", "direction", "Forecast trend direction (1=up, -1=down)", "trend"),
    ("Forecast Accuracy (Historical)", "%", "Estimated forecast accuracy based on historical stability", "accuracy"),
]

# Fixed values — scenario multipliers and constants used by the SQL forms.
FORECAST_GROWTH = 1.03
BAND_80 = (1.08, 0.95)
BAND_95 = (1.12, 0.90)
OCR_SHOCK = 0.97
TOURISM_SHOCK = 1.2
OCR_LONG_RUN = 3.5
LOAN = 750_000
LOAN_MONTHS = 360
PRICE_PER_CONSENT = 150.0
GDP_PC_ANCHOR = 50_000
