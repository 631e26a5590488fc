"""skeinlab.plans"""
