"""Thresholds, labels and weights of the scoring rules. Fixed values."""

HIGH_RISK, MEDIUM_RISK, CRITICAL_RISK = 0.61, 0.40, 0.75
SERVICES = ("phone_service", "multiple_lines", "online_security", "online_backup", "device_protection", "tech_support", "streaming_tv", "streaming_movies")
SCORE_WEIGHTS = {"churn": 0.30, "ltv": 0.30, "tenure": 0.20, "services": 0.20}
SCORE_CATEGORIES = ((80, "Excellent"), (60, "Good"), (40, "Moderate"), (20, "Poor"))
PRIORITIES = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
#: recommendation, priority, confidence (None: the probability), share of p * LTV saved.
RECOMMENDATIONS = (
    ("Offer Executive Retention & Fiber Upgrade Pack", "Critical", None, 1.0),
    ("Offer Annual Contract Migration Discount", "High", 0.85, 0.45),
    ("Offer Priority Telecom Tech Support", "Medium", 0.70, 0.15),
    ("Offer Multi-Service OTT & Security Bundle", "Low", 0.60, 0.10),
    ("Offer Autopay Billing Discount", "Medium", 0.75, 0.20),
    ("Standard Telecom Subscriber Loyalty Check-in", "Low", 0.50, 0.0),
)
#: strategy, share of the annual value as cost, fixed cost, churn reduction.
STRATEGIES = (
    ("Strategy A: 10% Contract Discount", 0.10, 0.0, 0.25),
    ("Strategy B: Priority VIP Tech Support", 0.0, 45.0, 0.35),
    ("Strategy C: Annual Plan Conversion + Speed Boost", 0.08, 20.0, 0.45),
    ("Strategy D: No Intervention (Baseline)", 0.0, 0.0, 0.0),
)
RETENTION_CAP = 0.95
#: Intercept and weights of the linear churn score.
LINEAR = {"intercept": -1.3, "Month-to-month": 1.1, "Two year": -1.2, "month": 0.03, "charge": 0.01, "Fiber optic": 0.5, "tech support": 0.4, "Electronic check": 0.3}
#: scenario, new contract, new tech support, new payment method, factor of the monthly charge (None: as it is).
SCENARIOS = (
    ("One-year contract", "One year", None, None, 1.0),
    ("Two-year contract", "Two year", None, None, 1.0),
    ("Technical support", None, "Yes", None, 1.0),
    ("Automatic payment", None, None, "Credit card (automatic)", 1.0),
    ("10% discount", None, None, None, 0.9),
)
#: feature, value it is compared with, impact if it holds, impact if not; the order decides ties.
IMPACT_BASE = 0.26
IMPACTS = (
    ("contract_type", "Month-to-month", 0.25, -0.15),
    ("tenure_months", 12, 0.18, -0.12),
    ("monthly_charges", 65, 0.12, -0.05),
    ("tech_support", "No", 0.08, -0.04),
    ("online_security", "No", 0.06, -0.03),
    ("payment_method", "Electronic check", 0.05, -0.02),
)
#: lowest probability, risk level, confidence, action, offer code, months, share of the charges recovered, steps.
ACTION_PLANS = (
    (HIGH_RISK, "CRITICAL CHURN RISK", 96.4, "Immediate Retention Outreach & 15% Contract Upgrade Discount", "RETENTION-FIBER-15", 12.0, 0.70, ("Deploy proactive retention call within 24 hours.", "Offer 15% billing discount for upgrading to a 1-year contract.", "Assign dedicated VIP technical support agent.")),
    (MEDIUM_RISK, "ELEVATED CHURN RISK", 91.2, "Retention Check-in & Free Speed Boost Add-on", "BOOST-SPEED-FREE", 6.0, 0.50, ("Send targeted email/SMS with 3-month free speed boost.", "Conduct customer satisfaction survey.", "Provide self-service billing optimization guide.")),
    (0.0, "LOW ATTRITION RISK", 94.8, "Cross-Sell Loyalty Rewards & Upsell Fiber", "LOYALTY-PLUS-500", 12.0, 0.15, ("Reward customer with 500 loyalty points.", "Promote smart home router upgrade.", "Enroll in auto-pay discount program.")),
)
#: Bounds of numbers and allowed values that a feature row must keep.
FEATURE_RANGES = {"tenure_months": (0.0, 120.0), "monthly_charges": (0.0, 500.0), "total_charges": (0.0, 50000.0)}
FEATURE_VALUES = {"gender": ("Male", "Female"), "partner": ("Yes", "No"), "dependents": ("Yes", "No"), "tech_support": ("Yes", "No", "No internet service"), "online_security": ("Yes", "No", "No internet service")}
#: Contact windows by whether the risk is critical, actions and message of a retention plan; marks stand for the subscriber's values.
CONTACT = {True: "CRITICAL (Contact within 24 Hours)", False: "HIGH (Contact within 48 Hours)"}
PLAN_ACTIONS = (
    "Review account history and identify primary friction point (Current contract: '{contract}').",
    "Initiate proactive customer success outreach call (Target priority: {priority}).",
    "Present annual contract upgrade offer with 12-month billing lock.",
    "Enroll account in VIP technical support escalation tier.",
)
PLAN_MESSAGE = (
    "Dear Valued Customer,\n\nThank you for being a loyal subscriber for the past {tenure} months. We noticed your current contract is up for renewal, and we want to ensure you are receiving the highest quality service.\n\n"
    "We are pleased to offer you an exclusive 15% billing credit when you lock in a 12-month plan today, along with complimentary priority technical support.\n\nBest regards,\nSubscriber Success Team"
)
#: Values of columns that a table of subscribers doesn't have.
COLUMN_DEFAULTS = {
    "gender": "Female", "senior_citizen": 0, "partner": "No", "dependents": "No", "tenure_months": 12, "phone_service": "Yes", "multiple_lines": "No", "internet_service": "Fiber optic", "online_security": "No", "online_backup": "No",
    "device_protection": "No", "tech_support": "No", "streaming_tv": "No", "streaming_movies": "No", "contract_type": "Month-to-month", "paperless_billing": "Yes", "payment_method": "Electronic check", "monthly_charges": 70.0, "total_charges": 840.0,
}
#: Columns of a model's input: type, lowest value, allowed values. None may be null.
MODEL_INPUT = {
    "customer_id": ("string", None, None), "tenure_months": ("int", 0, None), "monthly_charges": ("double", 0, None), "total_charges": ("double", 0, None), "contract_type": ("string", None, None),
    "paperless_billing": ("string", None, ("Yes", "No")), "internet_service": ("string", None, None), "tech_support": ("string", None, None),
}
#: Outreach by tone: subject, greeting and sign-off around one body; %1$s is the subscriber, %2$s the months.
TONES = {
    "Friendly": ("A special thank you for your %2$s months with us!", "Hi Account #%1$s,", "Warmly,\nYour Customer Success Team"),
    "Urgent": ("Priority Account Review & Exclusive Offer for Account #%1$s", "Dear Valued Account #%1$s,", "Sincerely,\nExecutive Customer Success Desk"),
    "Professional": ("Exclusive Annual Plan Upgrade Offer for Account #%1$s", "Dear Account #%1$s,", "Best regards,\nCustomer Retention Team"),
}
#: %1$s months, %2$s contract, %3$s strategy, %4$.2f monthly charge, %5$.2f saved in a year.
OUTREACH = (
    "We truly value your %1$s-month partnership with us. To show our appreciation and ensure you receive the best value for your subscription, we would like to invite you to upgrade your current %2$s subscription to our **%3$s**.\n\n"
    "**Your Personalized Offer Summary**:\n• Current Monthly Spend: $%4$.2f/mo\n• Recommended Action: %3$s\n• Estimated Annual Savings: $%5$.2f\n• Dedicated VIP Tech Support Included\n\n"
    "Please let us know if you would like us to apply this credit to your account today."
)
OUTREACH_SAVING, OUTREACH_LTV = 0.15, 0.35
#: Lowest probability, risk label and confidence of a prediction; fixed values. Below them the model's own threshold decides.
MODEL_LEVELS = ((0.90, "Very High Risk", "Very High"), (0.75, "High Risk", "High"), (0.60, "Medium Risk", "Medium"))
ABOVE_THRESHOLD, BELOW_THRESHOLD, SURE_BELOW = ("Low Risk", "Low"), "Minimal Risk", 0.15
#: Lowest probability, offer, priority, months and share of the monthly charge saved, of rows scored at ingestion; fixed texts.
INGEST_OFFERS = (
    (HIGH_RISK, "15% Contract Upgrade Discount + Priority Support", "Critical", 12.0, 0.7),
    (MEDIUM_RISK, "Retention Check-in & Free Speed Boost", "High", 6.0, 0.5),
    (0.0, "Standard Support & Loyalty Points", "Low", 0.0, 0.0),
)
#: Actions by whether risk and value are high; fixed texts.
QUADRANTS = {
    (True, True): ("Assign to VIP Dedicated Account Manager for outreach.", "Offer 20% loyalty discount on contract renewal.", "Provide complimentary premium tech support upgrade."),
    (True, False): ("Trigger automated digital survey touchpoint.", "Suggest downgrade to lower-cost tier or contract option."),
    (False, True): ("Evaluate eligibility for cross-selling premium products.", "Enroll in VIP loyalty reward circle program."),
    (False, False): ("Maintain standard digital engagement flow.",),
}
#: Reasons of the recommendations, in their order; marks stand for percent, value and services. Fixed texts.
REASONS = (
    ("Subscriber has High Churn Risk (%1$.1f%%)", "High subscriber lifetime valuation ($%2$.2f)", "High value subscriber retention target"),
    ("Flexible Month-to-month contract structure is active", "Migrating to 1-year telecom contract reduces churn probability by over 70%%"),
    ("High-speed internet is active but subscriber lacks Tech Support add-ons", "Tech support subscribers exhibit a 60%% reduction in attrition rates"),
    ("Active account has low service density (%3$d services)", "Bundling OTT entertainment, online backup, or security creates subscriber stickiness"),
    ("Manual billing payment method is active", "Autopay subscribers exhibit a 66%% lower attrition rate than manual check payers"),
    ("Subscriber account is highly stable and active",),
)
#: The retention offer of each segment; fixed texts.
CAMPAIGNS = {
    "High-Value Subscribers": "Offer Executive Retention & Fiber Upgrade Pack", "Loyal Subscribers": "Offer Multi-Service OTT & Security Bundle",
    "Growth Subscribers": "Offer Annual Contract Migration Discount", "Budget Subscribers": "Offer Autopay Billing Discount & Entry Fiber Upgrade",
}
CAMPAIGN = "Standard Loyalty Campaign"
